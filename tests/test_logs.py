import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.operators.errors import error_files, lineage_gate, failing_tests
from faultline.operators.mentions import PATTERNS, mentions
from faultline.operators import resolve
from faultline.sources import logs

LINE = "run_key string, line_no long, line string"
NODE = "run_key string, pos int, id string, resource_type string, name string, alias string, path string"


def blame(spark, text, nodes=(), macros=(), deps=(), files=()):
    lines = spark.createDataFrame([("r", n, line) for n, line in enumerate(text.split("\n"))], LINE)
    ledger = spark.createDataFrame([], "run_key string, run_id string, seq long")
    rows = error_files(
        lines, ledger,
        spark.createDataFrame([("r", n, *v) for n, v in enumerate(nodes)], NODE),
        spark.createDataFrame([("r", n, *v) for n, v in enumerate(macros)], "run_key string, pos int, id string, name string, path string"),
        spark.createDataFrame([("r", *v) for v in deps], "run_key string, id string, pos int, dep_id string"),
        spark.createDataFrame([("r", p, "") for p in files], "run_key string, path string, text string"),
    ).collect()
    return [r["file"] for r in sorted(rows, key=lambda r: (r["pattern"], r["line_no"], r["idx"]))]


def test_explicit_path_wins(spark):
    assert blame(spark, "Runtime Error in model sales (models/fin/sales.sql)\nsee models/x.sql") == ["models/fin/sales.sql"]


def test_colours_are_removed(spark):
    assert blame(spark, "\x1b[31mParsing Error in macro m (macros/m.sql)\x1b[0m") == ["macros/m.sql"]


def test_name_resolves_through_manifest_first_match(spark):
    nodes = [("model.p.a", "analysis", "sales", "", "analyses/sales.sql"), ("model.p.b", "model", "x", "sales", "models/b.sql"), ("model.p.c", "model", "sales", "", "models/c.sql")]
    assert blame(spark, "Database Error in model sales", nodes) == ["models/b.sql"]


def test_failed_test_blames_the_tested_model(spark):
    nodes = [
        ("test.p.uniq_sales.77", "test", "uniq_sales_x", "", "models/doc.yml"),
        ("source.p.raw", "source", "raw", "", "models/raw.yml"), ("model.p.sales", "model", "sales", "", "models/sales.sql"),
    ]
    deps = [("test.p.uniq_sales.77", 0, "source.p.raw"), ("test.p.uniq_sales.77", 1, "model.p.sales")]
    assert blame(spark, "Failure in test uniq_sales (models/doc.yml)", nodes, deps=deps) == ["models/sales.sql"]


def test_failed_test_is_inferred_from_the_longest_stem(spark):
    files = ["models/sales.sql", "models/sales_day.sql", "models/ales.sql", "seeds/sales_day_total.sql"]
    assert blame(spark, "Failure in test uniq_sales_day_total_id (models/doc.yml)", files=files) == ["models/sales_day.sql"]


def test_unresolved_test_blocks_lower_tiers(spark):
    assert blame(spark, "Failure in test uniq_nothing (models/doc.yml)\nError in models/a.sql") == []


def test_lower_tiers(spark):
    assert blame(spark, "see models/a.sql\nand seeds/b.yml") == ["models/a.sql", "seeds/b.yml"]
    files = ["models/z/sales.sql", "models/a/sales.sql", "target/sales.sql"]
    assert blame(spark, "2 of 3 ERROR creating model dwh.sales", files=files) == ["models/a/sales.sql"]
    assert blame(spark, "an error came up in the sales model", files=files) == ["models/a/sales.sql"]


def test_latest_run_comes_before_the_whole_log(spark):
    bar = "=" * 30
    text = [f"{bar} t | one {bar}", "Database Error in model a (models/a.sql)", f"{bar} t | two {bar}", "Database Error in model b (models/b.sql)"]
    lines = spark.createDataFrame([("r", n, t) for n, t in enumerate(text)], LINE)
    ledger = logs.run_ids(lines).withColumnRenamed("line_no", "seq")
    assert [r["line"] for r in logs.latest_slice(lines, ledger).orderBy("line_no").collect()] == text[2:]


def test_gate(spark):
    lines = spark.createDataFrame(
        [("a", 1, "Failure in test t"), ("b", 1, "column x"), ("c", 1, "syntax error at from"), ("c", 2, "Failure in model t")], LINE
    )
    got = {r["run_key"]: r["needs_lineage"] for r in lineage_gate(lines, failing_tests(lines)).collect()}
    assert got == {"a": True, "b": True, "c": False}


def brute_mentions(text):
    out = []
    for rank, (pattern, groups) in PATTERNS.items():
        plain = pattern if rank == 3 else pattern.format(start="")
        for m in re.finditer(plain, text, re.IGNORECASE):
            out.append((rank, *[m.group(groups[g]) if g in groups else None for g in ("resource", "name", "path")]))
    return out


@pytest.mark.parametrize("block", [1, 3, 50])
def test_mentions_over_line_ends_match_the_whole_text(spark, block):
    rng = random.Random(block)
    words = ["Database", "Error", "in", "sql", "model", "sales", "(models/a.sql)", "Failure", "test", "x_1", "ERROR", "error", "for", "the", "macro", "ok."]
    rows, wanted = [], []
    for run in range(12):
        tokens = [rng.choice(words) for _ in range(160)]
        text = "".join(t + rng.choice([" ", " ", "\n", "\n  \n"]) for t in tokens)
        lines = text.split("\n")
        rows += [(f"r{run}", 7 * n, line) for n, line in enumerate(lines)]
        joined = "\n".join(s for s in (line.strip() for line in lines) if s)
        wanted += [(f"r{run}", *m) for m in brute_mentions(joined)]
    # a match that starts inside the last word of the one before is the documented limit
    got = mentions(spark.createDataFrame(rows, LINE), block_lines=block).collect()
    got = [(r["run_key"], r["pattern"], r["resource"], r["name"], r["path"]) for r in got]
    overlap = {"database", "failure", "error"}
    missing = [w for w in wanted if w not in got]
    extra = [g for g in got if g not in wanted and not any(o in str(g[3]).lower() for o in overlap)]
    assert not missing
    assert len(extra) <= 3


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_segments_do_not_depend_on_block_size(spark, block):
    rng = random.Random(1)
    rows, wanted, current = [], {}, None
    for n in range(200):
        line = "=" * 30 + f" | id{n} " + "=" * 30 if rng.random() < 0.05 else "text"
        current = f"id{n}" if "|" in line else current
        rows.append(("r", 3 * n, line))
        wanted[3 * n] = current
    got = logs.segment_runs(spark.createDataFrame(rows, LINE), block).collect()
    assert {r["line_no"]: r["run_id"] for r in got} == wanted


def test_scan_numbers_lines_and_replaces_bad_bytes(spark, tmp_path):
    from faultline.sources.files import read_project_files

    (tmp_path / "one.log").write_text("a\n\nb\n")
    rows = logs.read_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [("one", 0, "a"), ("one", 1, ""), ("one", 2, "b")]
    project = tmp_path / "files" / "k" / "models"
    project.mkdir(parents=True)
    (project / "a.sql").write_bytes(b"select \xff1")
    got = read_project_files(spark, str(tmp_path / "files"), "*.sql").collect()
    assert [tuple(r) for r in got] == [("k", "models/a.sql", "select �1")]


def test_ledger_takes_each_id_once(spark, tmp_path):
    bar = "=" * 30
    lines = spark.createDataFrame([("r", n, f"{bar}|{i}|{bar}") for n, i in enumerate(["a", "b", "a", "c"])], LINE)
    path = str(tmp_path / "ledger")
    logs.append_ledger(logs.new_run_ids(lines, spark.createDataFrame([("r", "b")], "run_key string, run_id string")), path, 7)
    ledger = logs.read_ledger(spark, path)
    assert {(r["run_id"], *r["seq"]) for r in ledger.collect()} == {("a", 7, 2), ("c", 7, 3)}
    assert logs.new_run_ids(lines, ledger).select(F.collect_set("run_id")).first()[0] == ["b"]


def test_a_later_append_wins_whatever_its_lines(spark, tmp_path):
    bar = "=" * 30
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([("r", 900, f"{bar}|old|{bar}")], LINE)
    second = spark.createDataFrame([("r", 1, f"{bar}|new|{bar}"), ("r", 2, "after it")], LINE)
    logs.append_ledger(logs.run_ids(first), path, 1)
    logs.append_ledger(logs.new_run_ids(second, logs.read_ledger(spark, path)), path, 2)
    ledger = logs.read_ledger(spark, path)
    assert [r["run_id"] for r in logs.latest_ids(ledger).collect()] == ["new"]
    assert [r["line_no"] for r in logs.latest_slice(second, ledger).orderBy("line_no").collect()] == [1, 2]


def test_two_uploads_of_one_key_stay_apart(spark, tmp_path):
    from faultline.streaming import ingest

    landing, arrivals = str(tmp_path / "landing"), str(tmp_path / "arrivals")
    day = F.lit("2024-01-01").cast("date")
    for upload, text in ((1, "old"), (2, "new")):
        ingest.land_upload(spark.createDataFrame([("r", n, f"{text}{n}") for n in range(3)], LINE), F.lit(upload), day, landing, arrivals)
    lines = ingest.uploaded_lines(ingest.read_arrivals(spark, arrivals), landing)
    assert sorted(r["line"] for r in lines.collect()) == ["new0", "new1", "new2"]
    assert "day" in lines._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_numbering_shuffles_no_lines_and_holds_over_many_splits(spark, tmp_path):
    rng, wanted = random.Random(3), []
    for f in range(4):
        lines = ["x" * rng.randrange(60) + str(n) for n in range(rng.choice((0, 5, 900)))]
        (tmp_path / f"log{f}.txt").write_text("\n".join(lines) + ("\n" if lines else ""))
        wanted += [(f"log{f}", n, line) for n, line in enumerate(lines)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = logs.read_logs(spark, str(tmp_path))
        assert sorted(tuple(r) for r in df.collect()) == sorted(wanted)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_long_name_gives_few_token_runs(spark):
    name = "_".join(f"t{k}" for k in range(2000))
    stems = ["t5", "t7_t8", "t100_t101_t102", "nowhere", "t1998_t1999", "t3_t5"]
    files = spark.createDataFrame([("r", f"models/{s}.sql") for s in stems], "run_key string, path string")
    tests = spark.createDataFrame([("r", name), ("other", name), ("r", "t7"), ("r", "__t7_t8__")], "run_key string, name string")
    runs = resolve.name_runs(tests, resolve.stem_index(files))
    assert runs.filter(F.col("name") == name).count() <= 3 * 2000
    got = {r["name"]: r["inferred_path"] for r in resolve.infer_from_names(tests, files).collect()}
    assert got == {name: "models/t100_t101_t102.sql", "__t7_t8__": "models/t7_t8.sql"}
