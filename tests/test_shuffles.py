"""What is shuffled and written on the way: rows once, and no more of them than a result needs."""

import glob
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from faultline.operators import context, lineage, resolve
from faultline.plans import inputs, q_io
from faultline.plans.registry import Inputs
from faultline import session
from faultline.session import sieve, stage

FILES = "run_key string, path string, text string"


def plan(df):
    """The plan before it runs."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(tmp_path):
    """lineitem and part with nulls, repeated pairs and parts of two folders."""
    rng = random.Random(5)
    pairs = [(rng.randrange(4), rng.randrange(480, 520)) for _ in range(150)] + [(None, 490), (2, None)]
    lines = {"l_suppkey": [s for s, _ in pairs], "l_partkey": [p for _, p in pairs]}
    pq.write_table(pa.table({c: pa.array(v, pa.int64()) for c, v in lines.items()}), tmp_path / "lineitem.parquet")
    keys = list(range(480, 520))
    part = {
        "p_partkey": pa.array(keys, pa.int64()), "p_name": [f"big part {k % 7}" for k in keys], "p_brand": [f"Brand#{k % 5}" for k in keys],
        "p_type": [("LARGE", "SMALL", "PROMO", "ECONOMY")[k % 4] for k in keys], "p_size": pa.array([k % 50 + 1 for k in keys], pa.int32()),
    }
    pq.write_table(pa.table(part), tmp_path / "part.parquet")
    return str(tmp_path)


def test_neighbours_are_those_of_the_select_with_one_shuffle(spark, tables):
    made = inputs._lag(spark, tables)
    inputs.view(spark, tables, "lineitem").createOrReplaceTempView("lineitem")
    wanted = spark.sql(inputs.VIEWS["v_lag"])
    assert made.schema == wanted.schema
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(made.collect(), key=key) == sorted(wanted.collect(), key=key)
    assert plan(made).count("Exchange") == 1


def test_rows_of_a_manifest_are_shuffled_once(spark, tables):
    i = Inputs(spark, tables)
    for whole in (False, True):
        made = q_io._manifests(i, whole)
        assert plan(made).count("Exchange hashpartitioning") == 1
        assert made.select("run_key").distinct().count() == made.count()


def test_all_files_find_their_nodes_with_one_shuffle_of_each(spark):
    nodes = spark.createDataFrame(
        [("r", 3, "a", "model", "sales", "models/old/s.sql"), ("r", 1, "b", "model", "x", "models/sales.sql"), ("r", 2, "c", "seed", None, "seeds/s.csv"), (None, 0, "d", "model", "s", "s.sql")],
        "run_key string, pos int, id string, resource_type string, name string, path string",
    )
    files = spark.createDataFrame([("r", "models/sales.sql"), ("r", "models/old/s.sql"), ("r", "s.sql"), ("r", "none.sql"), ("r", None), (None, "s.sql"), ("r", "s.sql")], "run_key string, file string")
    found = lineage.find_nodes(files, nodes, few=False)
    got = sorted((str(r["run_key"]), str(r["file"]), r["node_id"]) for r in found.collect())
    assert got == [("None", "s.sql", None), ("r", "None", None), ("r", "models/old/s.sql", "c"), ("r", "models/sales.sql", "b"), ("r", "none.sql", None), ("r", "s.sql", "c"), ("r", "s.sql", "c")]
    assert plan(found.hint("merge")).count("Exchange") <= 2
    back = files.withColumn("file", F.replace("file", F.lit("/"), F.lit("\\")))
    by_path = {r["file"]: r["node_id"] for r in lineage.find_nodes(back, nodes).filter("run_key is not null").collect()}
    assert by_path == {"models\\sales.sql": "b", "models\\old\\s.sql": "a", "s.sql": "c", "none.sql": None, None: None}


@pytest.mark.parametrize("plain", [0, 100_000])
def test_a_sieve_loses_no_asked_row(spark, monkeypatch, plain):
    monkeypatch.setattr(session, "PLAIN_KEYS", plain)
    rows = spark.createDataFrame([(n, f"p{n % 700}") for n in range(9000)] + [(None, "p1"), (1, None), (None, None)], "a long, b string")
    asked = rows.filter("a is null or b is null or a % 3 = 0").withColumnsRenamed({"a": "x", "b": "y"})
    kept = sieve(rows, asked.unionByName(asked), {"a": "x", "b": "y"})
    got = sorted(map(str, kept.collect()))
    wanted = [str(r) for r in rows.collect() if r["a"] is None or r["b"] is None or r["a"] % 3 == 0]
    assert not set(wanted) - set(got) and len(got) == len(set(got)) and len(wanted) <= len(got) < 4500
    assert sieve(rows, asked.limit(0), {"a": "x", "b": "y"}).count() == 0


def test_many_hashes_are_broadcast_as_bits(spark):
    kept = sieve(spark.range(10), spark.range(200_000), {"id": "id"})
    marks = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" in marks and kept.count() == 10
    table = session._bits(spark.range(200_000).select(F.xxhash64("id").alias("_asked")), 1024)
    assert table.count() == 1024 and len(table.first()["_bits"]) == 64  # 512 bytes a row: 0.5 MB, where the hashes themselves took over 20


def test_staged_tables_are_packed(spark):
    found = stage(spark.range(0, 5, 1, 1), "packed")
    one = glob.glob(found.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "") + "/part-*.parquet")[0]
    assert pq.ParquetFile(one).metadata.row_group(0).column(0).compression == "ZSTD"


def test_symbols_without_texts_are_the_same_and_shuffle_no_text(spark):
    nodes = spark.createDataFrame(
        [("r", 1, "a", "model", "Orders", "models/a.sql"), ("r", 2, "b", "model", None, "models/b.sql"), ("r", 3, "c", "seed", "c", "models/none.sql"), (None, 4, "d", "model", "d", "models/a.sql")],
        "run_key string, pos int, id string, resource_type string, name string, path string",
    )
    files = spark.createDataFrame(
        [("r", "models/a.sql", "with x as (select {{ cents('y') }} as z from {{ ref('b') }})"), ("r", "models/a.sql", "select 1 as twice"), ("r", "models/b.sql", None), (None, "models/a.sql", "select 2 as w")],
        FILES,
    )
    whole = lineage.profiles(nodes, files).drop("text", "lowered")
    bare = lineage.profiles(nodes, files, texts=False)
    assert bare.columns == whole.columns
    assert sorted(map(str, bare.collect())) == sorted(map(str, whole.collect()))
    sides = [line for line in plan(bare.select("id", "symbols").hint("merge")).splitlines() if "Exchange" in line]
    assert not any("text#" in line for line in sides)


def brute(tests, files):
    out = {}
    for run, name in tests:
        fits = [(-len(s), p) for r, p in files if r == run and run is not None and p.startswith("models/") and p.endswith(".sql")
                for s in [p.rsplit("/", 1)[-1].removesuffix(".sql")] if s and f"_{s}_" in f"_{name}_"]
        if name is not None and fits:
            out[run, name] = min(fits)[1]
    return out


@pytest.mark.parametrize("share", [1, 3, 200_000])
@pytest.mark.parametrize("names_to_stems", [1, 1_000_000])
def test_names_travel_whole_and_find_the_longest_stem(spark, monkeypatch, share, names_to_stems):
    monkeypatch.setattr(resolve, "SHARE_STEMS", share)
    monkeypatch.setattr(resolve, "NAMES_TO_STEMS", names_to_stems)
    rng = random.Random(share)
    word = lambda n: "_".join(rng.choice("abc") for _ in range(n))
    files = [(rng.choice(["r", "s", None]), f"models/{rng.choice(['x', 'y'])}/{word(rng.randrange(1, 5))}.sql") for _ in range(60)]
    files += [("r", "models/.sql"), ("r", "macros/a.sql"), ("r", "models/a.yml"), ("s", None)]
    tests = [(rng.choice(["r", "s", "t", None]), word(rng.randrange(1, 8))) for _ in range(40)] + [("r", None), ("r", ""), ("r", "a__b"), ("r", "a__b")]
    found = resolve.infer_from_names(
        spark.createDataFrame(tests, "run_key string, name string"), spark.createDataFrame(files, "run_key string, path string")
    )
    rows = found.collect()
    got = {(r["run_key"], r["name"]): r["inferred_path"] for r in rows}
    wanted = brute(tests, [(r, p) for r, p in files if p])
    assert len(rows) == len(got) and got == wanted
    assert "hashpartitioning(run_key" in plan(found) and "stem#" not in "".join(x.split("hashpartitioning(")[1] for x in plan(found).splitlines() if "Exchange hashpartitioning" in x)


def test_a_manifest_file_per_key_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_io, "FILES_PER_TASK", 2)
    made = spark.createDataFrame([(f"k{n}", f'{{"n": {n}}}') for n in range(40)] + [(None, "{}")], "run_key string, json string")
    q_io._write_files(made, 41, str(tmp_path / "out"))
    found = glob.glob(str(tmp_path / "out/run_key=*/*.txt"))
    assert len(found) == 41 and len({f.rsplit("part-", 1)[1][:5] for f in found}) > 8
    assert spark.read.text(str(tmp_path / "out")).count() == 41


def test_definitions_shuffle_only_edges_to_sources_and_files_of_definitions(spark, monkeypatch):
    kept = {}
    real = context.sieve

    def noted(rows, asked, keys):
        out = real(rows, asked, keys)
        kept[tuple(keys)] = out
        return out

    monkeypatch.setattr(context, "sieve", noted)
    nodes = spark.createDataFrame([("r", f"m{n}", f"models/m{n}.sql") for n in range(30)], "run_key string, id string, path string")
    roots = nodes.select("run_key", F.col("id").alias("root_id"))
    deps = spark.createDataFrame([("r", f"m{n}", k, d) for n in range(30) for k, d in enumerate(["m1", "m2", "s1" if n % 3 else "none"])], "run_key string, id string, pos int, dep_id string")
    sources = spark.createDataFrame([("r", "s1", "one", "models/_s.yml"), ("r", "s2", "two", None), (None, "m1", "x", "y.yml")], "run_key string, id string, name string, path string")
    files = spark.createDataFrame([("r", f"models/m{n}.sql", "select 1") for n in range(30)] + [("r", "models/_s.yml", "a"), ("r", "models/_log.yml", "b"), ("r", "models/_else.yml", "c")], FILES)
    lines = spark.createDataFrame([("r", 1, "see models/_log.yml for it")], "run_key string, line_no long, line string")
    none = roots.withColumn("signals", F.array(F.lit("")))
    got = sorted((r["root_id"], r["key"], "_log" in r["text"]) for r in context.definition_sections(roots, lines, none, nodes, deps, sources, files).collect())
    wanted = [row for n in range(30) for row in ([(f"m{n}", "definition_1", False), (f"m{n}", "definition_2", True)] if n % 3 else [(f"m{n}", "definition_1", True)])]
    assert got == sorted(wanted)
    assert kept["run_key", "dep_id"].count() == 20 and kept["run_key", "path"].count() == 2
