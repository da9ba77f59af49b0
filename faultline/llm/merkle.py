"""Merkle manifest of a dataset as a persistent tree that is changed by copying paths.

A leaf is the digest of one row.  Leaves of a language ascend by doc_id and form a tree of arity 8; the
languages' roots form the tree above.  Trees are built in aligned blocks of 8**4 nodes, one block to a group,
so four levels cost one shuffle and no group ever exceeds 4,096 rows; the tops of the blocks are the leaves of
the next pass.  On the way down each block learns the siblings above it once, as one short text.

A tampered leaf makes a version of the tree: the ancestors inside its block are copied, every other node is
shared with the base, and the copied top of the block goes on as a version of the levels above, whose siblings
the block already knows.  So versions never meet each other and a hot block above the leaves does not exist.

Defined results: a null field counts as ``-``; rows without a language are a tree of their own, the first;
rows without a doc_id come first in their tree; ties are ordered by leaf, and equal rows are interchangeable.
An empty table has no leaves and no rows; only the five named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from faultline.session import stage

from .tables import BROADCAST_IDS

ARITY = 8
HEIGHT = 4  # levels of an aligned block: 8**4 nodes at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3
OWN, UP = "*", "/"  # in a path: the place of the own digest among its siblings, and the end of a level
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "tree string, pos long, n long, digest string"
_PATH = "tree string, pos long, path string, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of the fields in their fixed order, each with its length in bytes."""
    shown = []
    for name in FIELDS:
        value = fields[name].cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*shown), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and, of rows that are tampered with, the leaf of the tampered row."""
    fields = {name: F.col(name) for name in FIELDS}
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPER_EVERY)) == 0
    changed = leaf_digest(fields | {"text": F.translate("text", UPPER, LOWER)})
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # no null, same order
    return docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(fields).alias("leaf"), F.when(chosen, changed).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place in their tree (from 0) and the tree's size, by a range sort of the whole table.

    Each sorted partition numbers its rows; one small row per partition and tree says how many came before.
    """
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order, "row")]
    rows = stage(rows.orderBy(*by).withColumn("spot", F.monotonically_increasing_id()).drop("row"), "sorted")
    part = F.shiftright("spot", 33).alias("part")
    parts = rows.groupBy("tree", part).agg(F.min("spot").alias("low"), F.count("*").alias("size"))
    in_tree = Win.partitionBy("tree")
    before = F.sum("size").over(in_tree.orderBy("part").rowsBetween(Win.unboundedPreceding, -1))
    parts = parts.select("tree", "part", "low", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(in_tree).alias("n"))
    parts = stage(parts, "parts")  # at most one row for each partition and one for each tree
    small = parts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    placed = rows.withColumn("part", part).join(F.broadcast(parts) if small else parts, ["tree", "part"])
    return placed.withColumn("pos", F.expr("spot - low + before")).drop("part", "low", "before", "spot")


def block_levels(digests: list[str], n: int, height: int) -> list[list[str]]:
    """All levels of one block, lowest first, of a tree that has ``n`` nodes there: up to the root or the block's height."""
    levels = [digests]
    while n > 1 and len(levels) <= height:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
        n = -(-n // ARITY)
    return levels


def paths_down(levels: list[list[str]], above: str, to: int) -> list[str]:
    """For each node of level ``to`` its siblings up to the root, given those above the block."""
    paths = [above]
    for nodes in reversed(levels[to:-1]):
        paths = [_siblings(nodes, i) + UP + paths[i // ARITY] for i in range(len(nodes))]
    return paths


def _siblings(nodes: list[str], i: int) -> str:
    low = i - i % ARITY
    return "".join(nodes[low:i]) + OWN + "".join(nodes[i + 1 : low + ARITY])


def proof(path: str) -> str:
    return digest(path.replace(OWN, "").replace(UP, ""))


def copies(own: str, path: str) -> Iterator[str]:
    """The copied ancestors of a changed node, lowest first."""
    for siblings in path.split(UP)[:-1]:
        own = digest(siblings.replace(OWN, own))
        yield own


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _block(height: int) -> Column:
    return F.expr(f"pos div {ARITY**height}").alias("block")


def climb(nodes: DataFrame, height: int) -> DataFrame:
    """The tops of all blocks as the nodes of the next pass; a tree of one node stays as it is."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        n, pos = table["n"][0].as_py(), table["pos"][0].as_py()
        top = block_levels(table["digest"].to_pylist(), n, height)[-1][0]
        return pa.table({"tree": table["tree"][:1], "pos": [pos // width], "n": [-(-n // width)], "digest": [top]})

    width = ARITY**height
    return nodes.groupBy("tree", _block(height)).applyInArrow(run, _NODE)


def passes(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes of every pass, from the given ones to the roots of all trees."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        out.append(stage(climb(out[-1], height), "nodes"))
    return out


def _with_paths(nodes: DataFrame, above: DataFrame, height: int, run, schema: str) -> DataFrame:
    """``run(block, row of above)`` for each block of nodes and what stands above it."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(_sorted(left), {c: right[c][0].as_py() for c in right.column_names})

    block = nodes.groupBy("tree", _block(height))
    return block.cogroup(above.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(both, schema)


def descend(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The paths of ``nodes``, from the paths of their blocks' tops."""

    def run(table: pa.Table, top: dict) -> pa.Table:
        levels = block_levels(table["digest"].to_pylist(), table["n"][0].as_py(), height)
        paths = paths_down(levels, top["path"], 0)
        same = {c: [top[c]] * len(paths) for c in ("subroot", "root")}
        return pa.table({"tree": table["tree"], "pos": table["pos"], "path": paths, **same})

    return stage(_with_paths(nodes, above, height, run, _PATH), "paths")


def trees(docs: DataFrame, height: int) -> tuple[DataFrame, DataFrame, list[DataFrame], list[DataFrame]]:
    """Numbered leaves, the paths of their blocks, and the base nodes of all passes: below and above the languages' roots."""
    rows = stage(numbered(leaves(docs), ["doc_id", "leaf"]), "numbered")
    below = passes(rows.select("tree", "pos", "n", F.col("leaf").alias("digest")), height)
    subroots = below[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "digest")
    ranked = stage(numbered(subroots, ["lang_tree"]), "subroots")
    above = passes(ranked.select("tree", "pos", "n", "digest"), height)
    paths = above[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(above[:-1]):
        paths = descend(nodes, paths, height)
    named = ranked.select("pos", "lang_tree", F.col("digest").alias("subroot"))
    paths = paths.drop("tree", "subroot").join(named, "pos")
    paths = paths.select(F.col("lang_tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    for nodes in reversed(below[1:-1]):
        paths = descend(nodes, paths, height)
    return rows, paths, below, above


def _leaf_blocks(table: pa.Table, top: dict, height: int) -> Iterator[tuple[dict, str, str]]:
    """Each row of a block of leaves with its path, and the root that the block's base nodes give."""
    levels = block_levels(table["leaf"].to_pylist(), table["n"][0].as_py(), height)
    base = levels[-1][0]
    for base in copies(base, top["path"]):
        pass
    for row, path in zip(table.to_pylist(), paths_down(levels, top["path"], 0), strict=True):
        yield row, path, base


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root of the row's version and whether that is the root."""
    rows, paths, _, _ = trees(docs, height)

    def run(table: pa.Table, top: dict) -> pa.Table:
        out = []
        for row, path, folded in _leaf_blocks(table, top, height):
            if row["tampered"] is not None:
                folded = row["tampered"]
                for folded in copies(folded, path):
                    pass
            out.append((row["doc_id"], row["leaf"], top["subroot"], top["root"], proof(path), folded, folded == top["root"]))
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_paths(rows, paths, height, run, schema)


def versions(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes that each tampered leaf's version copies: doc_id, tree, pos, level (0: the leaf), digest.

    Level k of a language's tree stands at pos // 8**k; the levels of the tree above it follow.  All other
    nodes of a version are those of ``base_nodes``.
    """
    rows, paths, _, _ = trees(docs, height)

    def run(table: pa.Table, top: dict) -> pa.Table:
        out = []
        for row, path, _ in _leaf_blocks(table, top, height):
            if row["tampered"] is not None:
                own = [row["tampered"], *copies(row["tampered"], path)]
                out += [(row["doc_id"], row["tree"], row["pos"], level, node) for level, node in enumerate(own)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "tree", "pos", "level", "digest"])

    return _with_paths(rows, paths, height, run, "doc_id long, tree string, pos long, level int, digest string")


def base_nodes(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """All nodes of the base version: upper (true above the languages' roots), tree, level, pos, digest."""
    _, _, below, above = trees(docs, height)
    out = None
    for upper, nodes in ((False, below), (True, above)):
        for k, own in enumerate(nodes):
            part = _block_nodes(own, k, height).select(F.lit(upper).alias("upper"), "tree", "level", "pos", "digest")
            out = part if out is None else out.union(part)
    return out


def _block_nodes(nodes: DataFrame, k: int, height: int) -> DataFrame:
    """The nodes that pass ``k`` adds to those of the pass below it."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        first = table["pos"][0].as_py()
        levels = block_levels(table["digest"].to_pylist(), table["n"][0].as_py(), height)
        out = [(height * k + j, first // ARITY**j + i, node) for j, level in enumerate(levels) if j or not k for i, node in enumerate(level)]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        kinds = [pa.int32(), pa.int64(), pa.string()]
        found = pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["level", "pos", "digest"])
        return found.add_column(0, "tree", pa.array([table["tree"][0].as_py()] * len(found), pa.string()))

    return nodes.groupBy("tree", _block(height)).applyInArrow(run, "tree string, level int, pos long, digest string")
