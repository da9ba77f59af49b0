import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import lineage, resolve
from faultline.settings import LIMITS

PROFILE = "run_key string, id string, pos int, name string, path string, text string, lowered string, symbols array<string>"


def brute(root, signals, edges, nodes, cap, gated):
    """The walk as a plain queue, straight from its definition."""

    def score(node, wanted):
        return sum(3 if s in nodes[node][1] else int(s != "" and s in nodes[node][0]) for s in wanted)

    picked, seen, queue = [], {root}, [(root, 0, signals)]
    while queue and len(picked) < cap:
        parent, depth, wanted = queue.pop(0)
        if depth == 2:
            continue
        for node in sorted(edges.get(parent, []), key=lambda n: -score(n, wanted)):
            if node in seen or (gated and depth and score(node, wanted) <= 0):
                continue
            seen.add(node)
            picked.append((node, depth + 1, parent))
            queue.append((node, depth + 1, nodes[node][1]))
            if len(picked) == cap:
                break
    return picked


@pytest.mark.parametrize("seed, gated", [(1, True), (2, False), (3, True), (4, False)])
def test_walks_match_a_plain_queue(spark, seed, gated):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(12)]
    names = [f"n{n}" for n in range(40)]
    nodes = {n: (" ".join(rng.sample(words, 3)), sorted({*rng.sample(words, 2), n})) for n in names}
    # n0 is a hub, some nodes point to themselves, diamonds are common
    edges = {n: rng.sample(names, rng.choice([0, 1, 3, 5])) for n in names}
    edges["n0"] = names[:]
    signals = {n: rng.sample(words, 3) for n in names}
    profiles = spark.createDataFrame(
        [("r", n, k, n, f"models/{n}.sql", nodes[n][0], nodes[n][0], nodes[n][1]) for k, n in enumerate(names)], PROFILE
    )
    edge_rows = spark.createDataFrame(
        [("r", s, k, d) for s, ds in edges.items() for k, d in enumerate(ds)], "run_key string, src string, pos int, dst string"
    )
    rows = spark.createDataFrame([("r", n, s) for n, ss in signals.items() for s in ss], "run_key string, root_id string, signal string")
    parts = lineage.signal_parts(rows, per_part=2)
    roots = profiles.select("run_key", F.col("id").alias("root_id"))
    cap = LIMITS.max_upstream if gated else LIMITS.max_impact
    got = {}
    for r in lineage.walk(roots, parts, edge_rows, profiles, cap, gated).orderBy("root_id", "ord").collect():
        got.setdefault(r["root_id"], []).append((r["node_id"], r["depth"], r["parent_id"]))
    for n in names:
        assert got.get(n, []) == brute(n, signals[n], edges, nodes, cap, gated), n


def test_stem_hit_beats_a_later_exact_path(spark):
    nodes = spark.createDataFrame(
        [("r", 0, "a", "model", "sales", "", "models/old/s.sql"), ("r", 1, "b", "model", "x", "", "models/sales.sql")],
        "run_key string, pos int, id string, resource_type string, name string, alias string, path string",
    )
    files = spark.createDataFrame([("r", "models/sales.sql"), ("r", "models\\old\\s.sql"), ("r", "no.sql")], "run_key string, file string")
    got = {r["file"]: r["node_id"] for r in lineage.find_nodes(files, nodes).collect()}
    assert got == {"models/sales.sql": "a", "models\\old\\s.sql": "a", "no.sql": None}


def test_hot_root_signals_are_split(spark):
    rows = spark.createDataFrame([("r", "a", f"s{n}") for n in range(1000)] + [("r", "b", "x")], "run_key string, root_id string, signal string")
    parts = lineage.signal_parts(rows, per_part=50)
    sizes = [len(r["signals"]) for r in parts.filter("root_id = 'a'").collect()]
    assert sum(sizes) == 1000 and len(sizes) > 10
    assert parts.filter("root_id = 'b'").count() == 1


def _plan(spark, make):
    """Executed plan of a frame made while nothing is broadcast by itself, and its rows."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = make()
        return made._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, made.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_edges_are_shuffled_once(spark):
    nodes = spark.createDataFrame([("r", "a", "model"), ("r", "b", "seed"), ("r", "t", "test"), (None, "a", "model")], "run_key string, id string, resource_type string")
    deps = spark.createDataFrame([("r", "a", 3, "b"), ("r", "a", 1, "b"), ("r", "b", 0, "t"), ("r", "b", 0, None), (None, "a", 0, "a")], "run_key string, id string, pos int, dep_id string")
    plan, rows = _plan(spark, lambda: lineage.upstream_edges(nodes, deps))
    assert rows == [("r", "a", 1, "b")]
    assert plan.count("Exchange hashpartitioning") == 2


def test_names_nobody_asks_for_are_not_shuffled(spark):
    nodes = spark.createDataFrame([("r", n, "model", f"m_{n}", None, f"models/p_{n}.sql") for n in range(5)], "run_key string, pos long, resource_type string, name string, alias string, path string")
    macros = spark.createDataFrame([], "run_key string, pos long, id string, name string, path string")
    wanted = spark.createDataFrame([("r", "m_3"), ("r", "p_4"), ("s", "m_1"), (None, "m_2")], "run_key string, name string")
    plan, rows = _plan(spark, lambda: resolve.name_index(nodes, macros, wanted))
    assert rows == [("r", "m_3", "models/p_3.sql"), ("r", "p_4", "models/p_4.sql")]
    assert "BroadcastHashJoin [xxhash64" in plan


def test_nodes_are_cut_to_the_asked_before_a_shuffle(spark):
    """Of many nodes a few are asked for: only these are dealt out, and keys that repeat or are null do no harm."""
    rows = [("r", i, f"m.{i}", "model", f"n_{i}", None, f"models/n_{i}.sql") for i in range(50)] + [(None, 1, "m.x", "model", "n_1", None, None)]
    nodes = spark.createDataFrame(rows * 2, "run_key string, pos int, id string, resource_type string, name string, alias string, path string")
    wanted = spark.createDataFrame([("r", "models/n_3.sql"), ("r", "else/n_4.sql"), ("r", "none.sql"), (None, "n_1")], "run_key string, file string")
    found = lineage.find_nodes(wanted, nodes)
    assert "_asked" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.file, r.node_id) for r in found.collect()} == {("models/n_3.sql", "m.3"), ("else/n_4.sql", "m.4"), ("none.sql", None), ("n_1", None)}
    raw = nodes.select("run_key", "id", "pos", F.lit("m.7").alias("child_id"))
    roots = spark.createDataFrame([("r", "m.5")], "run_key string, root_id string")
    edges = lineage.near_edges(roots, raw, lambda d: lineage.downstream_edges(nodes, d))
    assert {(r.src, r.dst) for r in edges.collect()} == {("m.5", "m.7"), ("m.7", "m.7")}
