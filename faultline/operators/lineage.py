"""Bounded, relevance-ranked walks over model lineage.

Edges are ``(run_key, src, pos, dst)``: ``dst`` is a neighbour of ``src`` and ``pos`` its
place in the manifest list.  Depth is two, so a walk is two joins.  Neighbour lists are cut
to what the caps can ever use before they are joined to the roots, which keeps hub nodes
cheap without losing a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import symbols as S
from ..functions import text as T
from ..session import sieve, stage
from ..settings import LIMITS
from ..sources.logs import with_lookahead

SIGNALS_PER_PART = 512


def lineage_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("resource_type").isin(*P.LINEAGE_TYPES))


def profiles(nodes: DataFrame, files: DataFrame, texts: bool = True) -> DataFrame:
    """(run_key, id, pos, name, path, text, lowered, symbols), one row per lineage node.

    Symbols are extracted once per node, not once per comparison.  Without ``texts`` the columns text and lowered are
    left out, and symbols are extracted where the files lie, so that no text is shuffled.
    """
    text = T.blank_if_null(F.col("text"))
    sources = files.select("run_key", "path", "text" if texts else S.source_symbols(text).alias("used"))
    found = lineage_nodes(nodes).join(sources, ["run_key", "path"], "left")
    used = S.source_symbols(text) if texts else F.coalesce("used", F.array().cast("array<string>"))
    return found.select(
        "run_key", "id", "pos", "name", "path", *([text.alias("text"), F.lower(text).alias("lowered")] if texts else []),
        S.named_symbols(F.col("name"), F.col("path"), used).alias("symbols"),
    )


def _to_models(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    models = lineage_nodes(nodes).select("run_key", F.col("id").alias("dst"))
    # cut first: the rows of an edge then lie together by its target, so they are not shuffled again
    kept = edges.select("run_key", "src", "pos", "dst").join(models, ["run_key", "dst"], "left_semi")
    return kept.groupBy("run_key", "src", "dst").agg(F.min("pos").alias("pos")).select("run_key", "src", "pos", "dst")


def upstream_edges(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    return _to_models(deps.select("run_key", F.col("id").alias("src"), "pos", F.col("dep_id").alias("dst")), nodes)


def downstream_edges(nodes: DataFrame, child_map: DataFrame) -> DataFrame:
    return _to_models(
        child_map.select("run_key", F.col("id").alias("src"), "pos", F.col("child_id").alias("dst")), nodes
    )


def near_edges(roots: DataFrame, raw: DataFrame, to_edges) -> DataFrame:
    """Edges a walk from ``roots`` can use: out of the roots and out of their neighbours.

    ``raw(run_key, id, ...)`` is cut to those sources before ``to_edges`` touches it.
    """
    keys = roots.select("run_key", F.col("root_id").alias("id")).distinct()

    def out_of(asked: DataFrame) -> DataFrame:
        rows = sieve(raw, asked, {"run_key": "run_key", "id": "id"}).join(asked, ["run_key", "id"], "left_semi")
        return to_edges(stage(rows, "raw-edges"))

    first = stage(out_of(keys), "near-edges")
    reached = first.select("run_key", F.col("dst").alias("id")).distinct().join(keys, ["run_key", "id"], "left_anti")
    return first.unionByName(out_of(stage(reached, "reached")))


def tested_models(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(run_key, id, n, model_id): lineage models a test depends on, numbered from 1.

    Numbering counts the kept models only, in list order, repeats included.
    """
    models = lineage_nodes(nodes).select("run_key", F.col("id").alias("dep_id"))
    tests = nodes.filter(F.col("resource_type") == "test").select("run_key", "id")
    order = Window.partitionBy("run_key", "id").orderBy("pos")
    return (
        deps.join(tests, ["run_key", "id"], "left_semi")
        .join(models, ["run_key", "dep_id"], "left_semi")
        .select("run_key", "id", F.row_number().over(order).alias("n"), F.col("dep_id").alias("model_id"))
    )


def find_nodes(wanted: DataFrame, nodes: DataFrame, few: bool = True) -> DataFrame:
    """Add ``node_id`` to ``wanted(run_key, file)``: same path or same stem, first in order.

    A node of the same path has the same stem as well, so paths are looked up only if some file is written with
    backslashes, of which the stem knows nothing.  ``few`` files cut the nodes before any shuffle.
    """
    path, file = T.slashes(F.col("path")), F.col("file")
    by_paths = not wanted.filter(T.stem(file) != T.stem(T.slashes(file))).isEmpty()
    usable = lineage_nodes(nodes).filter(T.blank_if_null(F.col("path")) != "")
    found = wanted
    for by, value, own in (("stem", T.stem(file), [F.col("name"), T.stem(path)]), ("path", T.slashes(file), [path]))[: 1 + by_paths]:
        index = usable.select("run_key", "id", "pos", F.explode(F.array_distinct(F.array(*own))).alias(f"_{by}"))
        if few:
            index = sieve(index, wanted.select("run_key", value.alias(f"_{by}")), {"run_key": "run_key", f"_{by}": f"_{by}"})
        first = index.groupBy("run_key", f"_{by}").agg(F.min(F.struct("pos", "id")).alias(f"{by}_node"))
        found = found.withColumn(f"_{by}", value).join(first, ["run_key", f"_{by}"], "left")
    best = F.least("path_node", "stem_node") if by_paths else F.col("stem_node")
    return found.select(*[F.col(c) for c in wanted.columns], best.getField("id").alias("node_id"))


def find_tests(failing: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_key, test_id) for ``failing(run_key, test_name)``: first test node of that name."""
    from .resolve import test_idents

    # the names are read from logs: written, so that they are not read once more for each use
    named = stage(failing.select("run_key", S.clean_name(F.col("test_name")).alias("ident")), "failing")
    index = (
        sieve(test_idents(nodes), named, {"run_key": "run_key", "ident": "ident"})
        .groupBy("run_key", "ident").agg(F.min_by("id", "pos").alias("test_id"))
    )
    return named.join(index, ["run_key", "ident"]).select("run_key", "test_id")


# --- signals ---------------------------------------------------------------------------

def log_signals(slice_lines: DataFrame) -> DataFrame:
    """(run_key, signal): distinct symbols of the run's log, also of names that follow their keyword on the next line.

    Only lines that end in a keyword take the look-ahead; all other symbols lie inside a line.
    """
    inside = slice_lines.select("run_key", F.explode(S.error_signals(F.col("line"))).alias("signal"))
    open_end = T.strip(F.col("line")).rlike("(?iU)" + P.OPEN_KEYWORD)
    ahead = with_lookahead(slice_lines, open_end)
    last = F.regexp_extract(T.strip(F.col("line")), "(?iU)" + P.OPEN_KEYWORD, 0)
    across = ahead.select("run_key", F.explode(S.leading_signals(F.concat(last, F.lit("\n"), F.substring_index("ahead", "\n", 1)))).alias("signal"))
    return inside.union(across).distinct()


def own_signals(roots: DataFrame, node_profiles: DataFrame) -> DataFrame:
    """(run_key, root_id, signal): what a root's source refers to."""
    keys = roots.select("run_key", "root_id").distinct()
    return keys.join(
        node_profiles.select("run_key", F.col("id").alias("root_id"), "text"), ["run_key", "root_id"]
    ).select("run_key", "root_id", F.explode(S.refs(F.col("text"))).alias("signal"))


def root_signals(roots: DataFrame, run_signals: DataFrame, node_profiles: DataFrame) -> DataFrame:
    """(run_key, root_id, signal): the run's signals plus what the root's source refers to.

    Every root gets a copy of its run's signals: only where blocks are shortened by them.  Scores take the
    two kinds apart (:func:`relevance_scores`).
    """
    keys = roots.select("run_key", "root_id").distinct()
    own = own_signals(roots, node_profiles)
    return keys.join(run_signals, "run_key").select("run_key", "root_id", "signal").unionByName(own).distinct()


def run_parts(run_signals: DataFrame) -> DataFrame:
    """(run_key, signals): a run's signals as arrays of bounded size."""
    return signal_parts(run_signals.select("run_key", F.lit("").alias("root_id"), "signal")).drop("root_id")


def signal_parts(signals: DataFrame, per_part: int = SIGNALS_PER_PART) -> DataFrame:
    """(run_key, root_id, signals): the signals of a root as arrays of bounded size.

    A root with very many signals gets several rows, so no array grows with the log.
    """
    parts = signals.groupBy("run_key", "root_id").agg(
        F.ceil(F.count("*") / F.lit(per_part)).cast("long").alias("n_parts")
    )
    return (
        signals.join(parts, ["run_key", "root_id"])
        .groupBy("run_key", "root_id", F.pmod(F.xxhash64("signal"), "n_parts").alias("part"))
        .agg(F.collect_list("signal").alias("signals"))
        .drop("part")
    )


def relevance_scores(
    pairs: DataFrame, node_profiles: DataFrame, parts: DataFrame, of_run: DataFrame | None = None
) -> DataFrame:
    """Add ``score`` to ``pairs(run_key, root_id, dst, pos)`` from the root's signal parts.

    With ``of_run`` (:func:`run_parts`), ``parts`` holds only signals that the run does not have; the run's
    are scored once per node, not once per root.
    """
    # signals travel to the nodes, not texts to the roots: they are far smaller
    texts = node_profiles.select("run_key", F.col("id").alias("dst"), "symbols", "lowered")
    points = S.relevance(F.col("symbols"), F.col("lowered"), F.col("signals")).alias("part_score")
    scored = pairs.join(parts, ["run_key", "root_id"], "left").join(texts, ["run_key", "dst"]).select(*pairs.columns, points)
    own = scored.groupBy(*pairs.columns).agg(F.sum("part_score").cast("int").alias("score"))
    if of_run is None:
        return own
    nodes = pairs.select("run_key", "dst").distinct().join(texts, ["run_key", "dst"]).join(of_run, "run_key")
    shared = nodes.select("run_key", "dst", points).groupBy("run_key", "dst").agg(F.sum("part_score").cast("int").alias("run_score"))
    total = F.col("score") + F.coalesce("run_score", F.lit(0))
    return own.join(shared, ["run_key", "dst"], "left").select(*pairs.columns, total.alias("score"))


def edge_scores(edges: DataFrame, node_profiles: DataFrame) -> DataFrame:
    """Score each edge's target by the symbols of its source node."""
    src = node_profiles.select("run_key", F.col("id").alias("src"), F.col("symbols").alias("signals"))
    dst = node_profiles.select("run_key", F.col("id").alias("dst"), "symbols", "lowered")
    return edges.join(src, ["run_key", "src"]).join(dst, ["run_key", "dst"]).select(
        "run_key", "src", "pos", "dst",
        S.relevance(F.col("symbols"), F.col("lowered"), F.col("signals")).alias("score"),
    )


# --- walks -----------------------------------------------------------------------------

def walk(
    roots: DataFrame,
    parts: DataFrame,
    edges: DataFrame,
    node_profiles: DataFrame,
    max_models: int,
    gated: bool,
    of_run: DataFrame | None = None,
) -> DataFrame:
    """(run_key, root_id, ord, depth, node_id, parent_id, score) of each root's walk.

    ``parts(run_key, root_id, signals)`` as made by :func:`signal_parts`.  Children of a
    root rank by the root's signals, deeper ones by their parent's symbols;
    with ``gated`` a deeper child without any overlap is passed over and may still be
    found under another parent.  ``ord`` is the order of discovery, capped per root.
    """
    root_keys = roots.select("run_key", "root_id").distinct()
    first_pairs = root_keys.join(
        edges.select("run_key", F.col("src").alias("root_id"), "pos", "dst"), ["run_key", "root_id"]
    ).filter(F.col("dst") != F.col("root_id"))
    by_root = Window.partitionBy("run_key", "root_id").orderBy(F.desc("score"), "pos")
    first = stage(
        relevance_scores(first_pairs, node_profiles, parts, of_run)
        .withColumn("rank", F.row_number().over(by_root))
        .filter(F.col("rank") <= max_models)
        .select("run_key", "root_id", F.col("dst").alias("node_id"), "rank", "score"),
        "first-steps",
    )

    # at most max_models + 1 of a parent's children can be seen already, so this many of
    # its best ones always hold every child the walk could still take
    useful = 2 * max_models + 1
    by_parent = Window.partitionBy("run_key", "src").orderBy(F.desc("score"), "pos")
    parents = first.select("run_key", F.col("node_id").alias("src")).distinct()
    steps = edge_scores(edges.join(parents, ["run_key", "src"], "left_semi"), node_profiles)
    if gated:
        steps = steps.filter(F.col("score") > 0)
    steps = (
        steps.withColumn("step", F.row_number().over(by_parent))
        .filter(F.col("step") <= useful)
        .select("run_key", F.col("src").alias("parent_id"), F.col("dst").alias("node_id"), "step", F.col("score").alias("step_score"))
    )
    second = (
        first.select("run_key", "root_id", F.col("node_id").alias("parent_id"), "rank")
        .join(steps, ["run_key", "parent_id"])
        .filter(F.col("node_id") != F.col("root_id"))
        .join(first.select("run_key", "root_id", "node_id"), ["run_key", "root_id", "node_id"], "left_anti")
        .groupBy("run_key", "root_id", "node_id")
        .agg(F.min(F.struct("rank", "step", "parent_id", "step_score")).alias("via"))
        .select(
            "run_key", "root_id", "node_id", F.lit(2).alias("depth"), F.col("via.rank").alias("rank"),
            F.col("via.step").alias("step"), F.col("via.parent_id").alias("parent_id"),
            F.col("via.step_score").alias("score"),
        )
    )
    found = first.select(
        "run_key", "root_id", "node_id", F.lit(1).alias("depth"), "rank", F.lit(0).alias("step"),
        F.col("root_id").alias("parent_id"), "score",
    ).unionByName(second)
    order = Window.partitionBy("run_key", "root_id").orderBy("depth", "rank", "step")
    return (
        found.withColumn("ord", F.row_number().over(order))
        .filter(F.col("ord") <= max_models)
        .select("run_key", "root_id", "ord", "depth", "node_id", "parent_id", "score")
    )


def upstream(roots: DataFrame, parts: DataFrame, edges: DataFrame, node_profiles: DataFrame, of_run: DataFrame | None = None) -> DataFrame:
    return walk(roots, parts, edges, node_profiles, LIMITS.max_upstream, gated=True, of_run=of_run)


def impact(roots: DataFrame, parts: DataFrame, edges: DataFrame, node_profiles: DataFrame, of_run: DataFrame | None = None) -> DataFrame:
    return walk(roots, parts, edges, node_profiles, LIMITS.max_impact, gated=False, of_run=of_run)
