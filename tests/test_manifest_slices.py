"""Manifests read entry by entry give the tables of manifests read as one value."""

import json
import random

import pytest

from faultline.sources import manifest

ODD = ['a,b', 'quote " in, it', 'back\\slash\\', '}{][', 'x: {"y": [1, 2]}', 'é ü', 'line\nend', '\\",{', '']


def body(rng, n):
    name = lambda: rng.choice(ODD) + str(rng.randrange(1000))
    nodes = {
        f"model.{k}.{name()}": {
            "resource_type": rng.choice(("model", "test")), "name": name(), "alias": rng.choice((None, name())), "original_file_path": f"models/{name()}.sql",
            "tags": [name(), [], {}], "test_metadata": {"name": name(), "kwargs": {"values": ["a_1", 0, {"k": "b,}"}]}},
            "depends_on": {"nodes": [f"model.{rng.randrange(n)}.x" for _ in range(rng.randrange(4))], "macros": [name()]},
        } for k in range(n)
    }
    return {
        "metadata": {"version": "1,2", "env": {}, "list": [1, 2, {"a": [3, 4]}]}, "flag": True, "none": None, "list": [1, [2, 3], "}"], "empty": {},
        "nodes": nodes, "docs": {}, "macros": {f"macro.{k}": {"name": name(), "original_file_path": "m,{.sql"} for k in range(5)},
        "sources": {}, "child,map": {"a": 1, "b": 2}, "child_map": {f"model.{k}": [f"c.{k}, {j}" for j in range(k % 4)] for k in range(n)}, "last": [[], {}],
    }


def written(path, key, text):
    target = path / key / "target"
    target.mkdir(parents=True)
    (target / "manifest.json").write_text(text, encoding="utf-8")


def tables(found):
    made = {
        "nodes": manifest.nodes(found), "macros": manifest.named_entries(found, "macros"), "sources": manifest.named_entries(found, "sources"),
        "deps": manifest.deps(found), "macro_deps": manifest.macro_deps(found), "child_map": manifest.child_map(found),
    }
    return {name: (df.dtypes, sorted(map(str, df.collect()))) for name, df in made.items()}


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_slices_over_many_splits_equal_whole_values(spark, tmp_path, small_splits):
    rng = random.Random(5)
    written(tmp_path, "tight", json.dumps(body(rng, 30), separators=(",", ":")))
    written(tmp_path, "wide", json.dumps(body(rng, 12), indent=2, ensure_ascii=False))
    written(tmp_path, "plain", json.dumps(body(rng, 20)))
    written(tmp_path, "one", '{"nodes": {"a": {"name": "x", "original_file_path": "p"}}}\n')
    written(tmp_path, "none", "{}")
    whole, sliced = (tables(manifest.read_manifests(spark, str(tmp_path), value_bytes=size)) for size in (1 << 20, 0))
    assert len(whole["nodes"][1]) == 63
    assert sliced == whole
    # both ways side by side
    assert tables(manifest.read_manifests(spark, str(tmp_path), value_bytes=100)) == whole


BROKEN = [
    '{"nodes": {"a": ', '{"nodes": {"a": {"name": "x"}', '{"nodes": {"a": {"name": "x"}}', '[{"nodes": {"a": {"name": "x"}}}]', '"nodes"', "", "   ",
    '{"nodes": {"a": {"name": "x"}, }}', '{"nodes": {, "a": {"name": "x"}}}', '{"nodes": {"a": {"name": "x"}, "b": {"name": nope}}}',
    '{"nodes": {"a": {"name": "x"}}, "docs": [1, two]}', '{"nodes": {"a": {"name": "x}}}', '{"nodes": {"a": {"name": "x"}},}', '{, "nodes": {"a": {"name": "x"}}}',
    '{"nodes": {"a": {"name": "x"}]}', '{"nodes": {"a": [1}, "b": {"name": "x"}}}', '{"nodes": {"a": {"name": "x"}, "b"}}',
]


def test_malformed_files_leave_nothing_either_way(spark, tmp_path, small_splits):
    for k, text in enumerate(BROKEN):
        written(tmp_path, f"broken{k:02}", text)
    written(tmp_path, "sound", '{"nodes": {"a": {"name": "x"}}}')
    for size in (1 << 20, 0):
        found = manifest.nodes(manifest.read_manifests(spark, str(tmp_path), value_bytes=size))
        assert [r["run_key"] for r in found.collect()] == ["sound"]


def test_a_manifest_above_the_limit_of_a_parsed_value(spark, tmp_path):
    text = "select " + "x" * 4000 + ", 1"
    nodes = {f"model.{k}": {"name": f"n{k}", "original_file_path": "p.sql", "raw_code": text, "depends_on": {"nodes": [f"model.{k - 1}"]}} for k in range(34_000)}
    written(tmp_path, "big", json.dumps({"metadata": {}, "nodes": nodes}))
    found = manifest.read_manifests(spark, str(tmp_path))
    rows = {r["id"]: (r["pos"], r["name"]) for r in manifest.nodes(found).select("id", "pos", "name").collect()}
    assert rows == {f"model.{k}": (k, f"n{k}") for k in range(34_000)}
    assert manifest.deps(found).count() == 34_000


def test_a_manifest_file_per_project_however_many_folders(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from faultline.plans import q_io

    nodes = [("r1", 600 * n, f"model.{n}/x", "model", f"m{n}", None, f"models/m{n}.sql", None, None) for n in range(12)]
    nodes += [("r1", 601, "test.1", "test", "t", None, "_schema.yml", "key", "unique"), ("r2", 7, "model.9", "model", "m", "a", "p.sql", None, None)]
    columns = "run_key string, pos long, id string, resource_type string, name string, alias string, path string, column_name string, test_kind string"
    made = SimpleNamespace(
        spark=spark, v_nodes=spark.createDataFrame(nodes, columns),
        v_deps=spark.createDataFrame([("r1", "test.1", 0, "model.1/x")], "run_key string, id string, pos int, dep_id string"),
        v_macro_deps=spark.createDataFrame([], "run_key string, id string, pos int, macro_id string"),
    )
    monkeypatch.setattr(q_io, "work_dir", lambda spark, purpose: str(tmp_path / purpose))
    rows = q_io.manifest_slices(made).select("run_key", "pos", "id").collect()
    places = {}
    for row in sorted(nodes, key=lambda row: row[1]):
        places.setdefault(f"{row[0]}_{row[1] // 1000}", []).append(row[2])
    assert sorted(map(tuple, rows)) == sorted((key, n, row) for key, ids in places.items() for n, row in enumerate(ids))
    assert len(places) > 2 and len(list(tmp_path.glob("manifest-slices/run_key=*"))) == 2
