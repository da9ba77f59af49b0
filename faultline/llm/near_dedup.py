"""Near-duplicate groups by b-bit MinHash.

A document's set holds its distinct n-word shingles.  Band keys of MinHash minima bring candidates
together; the low bits of all minima, packed, estimate each candidate's similarity by bit counts,
corrected for chance agreement; links are then confirmed on the full sets.

How hot groups are kept linear: equal sets are one node before any candidate is made.  In each
round a bucket names one pivot, every member meets the best pivot of its buckets only, and linked
members become one component.  What is left are members that no pivot links to their bucket.  Their packed bits are
compared in blocks where a bucket has few of them; a bucket of many, as of pages of one template, counts as close.  Close
members of different components then meet by rare shingles only: sorted by frequency, a set and a smaller one that
reaches the threshold with it share a shingle at their beginnings.  Those that a shared shingle ties together are
compared on full sets, in blocks of bounded size that are dealt out evenly and return spanning edges, never pairs.

Defined results: a text without words (or null) has no shingles and is linked with nothing; a
null id has a null component and is kept; rows that repeat an id share what any of them links.
Nodes are numbers of distinct sets, not ids, so texts that share an id are each judged by their own set.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import stage

from . import words as W
from .components import components
from .tables import BROADCAST_IDS, binaries, bounded_batches, by_key, fixed_rows, only_ids


@dataclass(frozen=True)
class NearDup:
    """Parameters.  A pair at the threshold misses every band with a chance of 5e-8."""

    shingle_words: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 4
    bits: int = 4  # low bits that are kept of each minimum; divides 8
    margin: float = 6.0  # standard errors below the threshold at which an estimate still counts
    star_rounds: int = 2
    block_rows: int = 512
    block_shingles: int = 1 << 18
    few_rows: int = 512  # unlinked members up to which a bucket is compared by bits
    seed: int = 17


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row_key, text; rows equal in id and text have one key."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("row_key"), "text")


def signatures(rows: DataFrame, p: NearDup) -> DataFrame:
    """id, row_key, n_shingles, set_key (128-bit digest of the set), band_keys, packed low bits of (id, row_key, text)."""
    a = W.constants(p.bands * p.rows, p.seed)
    salt = W.constants(p.bands, p.seed + 1)
    per_byte = 8 // p.bits

    def run(batches):
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(2))
            for low, high in W.slices(bounds):
                first, sets, at = _sets(data, bounds, low, high, p)
                count = np.diff(at)
                full = np.flatnonzero(count)
                minima = np.empty((len(full), len(a)), np.uint64)
                digest = np.zeros((high - low, 2), np.uint64)
                if len(full):
                    work = np.empty_like(sets)
                    for k, multiplier in enumerate(a):
                        np.multiply(sets, multiplier, out=work)
                        minima[:, k] = np.minimum.reduceat(work, at[full])
                    digest[full, 0] = np.add.reduceat(W.mix(sets + np.uint64(1)), at[full])
                    digest[full, 1] = np.add.reduceat(W.mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[full])
                low_bits = (W.mix(minima) & np.uint64((1 << p.bits) - 1)).astype(np.uint8).reshape(len(full), len(a) // per_byte, per_byte)
                packed = np.zeros((high - low, len(a) // per_byte), np.uint8)
                packed[full] = (low_bits << (np.arange(per_byte, dtype=np.uint8) * np.uint8(p.bits))).sum(2, dtype=np.uint8)
                keys = np.zeros((len(full), p.bands), np.uint64)
                for r in range(p.rows):
                    keys = W.mix(keys + minima[:, r :: p.rows] + salt)
                flat = pa.array(keys.astype(np.int64).ravel())
                offsets = np.zeros(high - low + 1, np.int32)
                np.cumsum((count > 0) * p.bands, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array(count),
                        fixed_rows(digest),
                        pa.ListArray.from_arrays(pa.array(offsets), flat),
                        fixed_rows(packed),
                    ],
                    ["id", "row_key", "n_shingles", "set_key", "band_keys", "packed"],
                )

    return rows.mapInArrow(run, "id long, row_key long, n_shingles long, set_key binary, band_keys array<long>, packed binary")


def _sets(data, bounds, low, high, p):
    """Sorted distinct shingle hashes of the texts low..high, and where each text's begin."""
    chunk = W.lowered(data[bounds[low] : bounds[high]])
    starts, ends, first = W.word_bounds(chunk, bounds[low : high + 1] - bounds[low])
    grams, at = W.ngram_hashes(W.word_hashes(chunk, starts, ends), first, p.shingle_words)
    parts = [np.unique(grams[x:y]) for x, y in zip(at, at[1:], strict=False)]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=out[1:])
    return first, np.concatenate(parts) if parts else grams, out


def full_sets(rows: DataFrame, p: NearDup) -> DataFrame:
    """rep and the whole set as sorted 64-bit hashes in one binary value, of (rep, text)."""

    def run(batches):
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(1))
            for low, high in W.slices(bounds):
                _, sets, at = _sets(data, bounds, low, high, p)
                parts = [sets[x:y] for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), binaries(parts)], ["rep", "shingles"])

    return rows.mapInArrow(run, "rep long, shingles binary")


def least_agreement(p: NearDup) -> int:
    """Equal low-bit groups that a pair needs to count as a candidate.

    Two different minima agree in their low bits with chance c = 2**-bits, so a similarity J shows
    as agreement c + (1 - c) J.  The bound lies ``margin`` standard errors below that of the threshold.
    """
    k, c = p.bands * p.rows, 2.0**-p.bits
    agree = c + (1 - c) * p.percent / 100
    return int(np.floor(k * agree - p.margin * np.sqrt(k * agree * (1 - agree))))


def agreement(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Number of equal low-bit groups; both are uint64 rows of packed signatures."""
    differ = left ^ right
    shift = 1
    while shift < bits:  # a group's lowest bit becomes 1 if any of its bits differs
        differ = differ | (differ >> np.uint64(shift))
        shift *= 2
    lowest = np.uint64(sum(1 << k for k in range(0, 64, bits)))
    total = left.shape[-1] * (64 // bits)
    return total - np.bitwise_count(differ & lowest).sum(-1, dtype=np.int64)


def _views(column: pa.Array) -> list[np.ndarray]:
    """Each binary value as 64-bit numbers, without a copy."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return [np.frombuffer(data, np.uint64, (y - x) // 8, x) if y > x else np.zeros(0, np.uint64) for x, y in zip(bounds, bounds[1:], strict=False)]


def _agree_column(p: NearDup):
    """Agreement of two packed columns, of whole Arrow batches."""

    width = p.bands * p.rows * p.bits // 64

    @F.arrow_udf("int")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = (np.concatenate([*_views(x), np.zeros(0, np.uint64)]).reshape(len(x), width) for x in (a, b))
        return pa.array(agreement(left, right, p.bits).astype(np.int32))

    return agree


def _linked(p: NearDup):
    """Whether two full sets reach the threshold."""

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for u, v in zip(_views(a), _views(b), strict=True):
            both = len(u) + len(v) - len(np.union1d(u, v))
            out.append(100 * both >= p.percent * (len(u) + len(v) - both))
        return pa.array(out, pa.bool_())

    return linked


def near_groups(docs: DataFrame, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest linked id) and kept."""
    marks, reps, edges = _linked_sets(_narrow(docs, id_col, text_col), p, F.col("id").isNotNull(), {"low": F.min("id")})
    groups = _lowest(reps, edges.union(_id_links(marks, reps)), ["low"])
    out = marks.select("id", "n_shingles", "set_key").join(groups, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("id")))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def surplus_rows(docs: DataFrame, row_col: str, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keys in ``row_col`` of the rows that a group can spare: all but its smallest (id, key), rows without an id last.

    Every row is judged by its own text, also if others share its id or it has none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(row_col).alias("row_key"), F.col(text_col).alias("text"))
    one = F.struct(F.col("id").isNull().alias("bare"), F.coalesce("id", F.lit(0)).alias("id"), F.col("row_key"))
    marks, reps, edges = _linked_sets(rows, p, F.lit(True), {"first": F.min(one)})
    taking = marks.filter("n_shingles > 0").join(_lowest(reps, edges, ["first"]), "set_key")
    return taking.filter(one != F.col("first")).select(F.col("row_key").alias(row_col)).distinct()


def _linked_sets(rows: DataFrame, p: NearDup, part, least: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks of all (id, row_key, text) rows, the distinct sets of those in ``part``, and links (a, b) of sets.

    A set has a number (rep), which is its node, the key of one of its rows, and the aggregates ``least``.
    """
    bounded_batches(rows.sparkSession)
    marks = stage(signatures(rows, p), "signatures")
    reps = marks.filter("n_shingles > 0").filter(part).groupBy("set_key").agg(
        F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"), F.first("band_keys").alias("band_keys"),
        F.first("packed").alias("packed"), *(how.alias(name) for name, how in least.items()),
    )
    reps = stage(reps.withColumn("rep", F.monotonically_increasing_id()), "sets")
    keyed = reps.select("rep", F.explode("band_keys").alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    # Spark takes an exploded row for as small as one of its 32 and would broadcast all of them
    members = stage(keyed.hint("merge").join(shared, "key"), "members")
    signs = reps.join(members.select("rep").distinct(), "rep", "left_semi")
    signs = stage(signs.select("rep", "row_key", "n", "packed"), "signs")
    needed, signs = signs.select("row_key", "rep"), signs.drop("row_key")
    texts = only_ids(rows.select("row_key", "text"), needed, "row_key", "inner", BROADCAST_IDS // 2).select("rep", "text")
    sets = stage(full_sets(texts, p).dropDuplicates(["rep", "shingles"]), "shingles")

    edges = None
    labels = signs.select("rep", F.col("rep").alias("component"))
    for turn in range(p.star_rounds):
        found = _star_links(members, labels, signs, sets, p, turn)
        edges = found if edges is None else edges.union(found)
        edges = stage(edges, "links")
        labels = _labels(signs, edges)
    loose = _loose(members.join(labels, "rep").select("key", "rep", "component"), signs, p)
    around = components(edges.union(stage(loose, "loose")))
    clusters = labels.join(around.select(F.col("node").alias("rep"), F.col("component").alias("key")), "rep")
    several = clusters.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    tied = _tied(stage(clusters.join(several, "key").select("key", "rep", "component"), "clusters"), sets, p)
    weighed = sets.select("rep", F.col("shingles").alias("load"), F.expr("length(shingles) div 8").alias("weight"))
    rest = _blocks(tied, weighed, p, _close_by_sets(p))
    return marks, reps, edges.union(rest)


def _id_links(marks: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges from the first to each set of every id that has several."""
    taking = marks.filter("n_shingles > 0 and id is not null").select("id", "set_key")
    key = F.xxhash64("set_key")
    several = stage(taking.groupBy("id").agg(F.min(key).alias("x"), F.max(key).alias("y")).filter("x <> y").select("id"), "several")
    own = taking.join(several, "id").distinct().join(reps.select("set_key", "rep"), "set_key").select("id", "rep")
    own = stage(own, "own")
    first = own.groupBy("id").agg(F.min("rep").alias("a"))
    return own.join(first, "id").select("a", F.col("rep").alias("b"))


def _lowest(reps: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """set_key and the smallest of each named column of ``reps`` over the sets that ``edges`` connect."""
    final = components(edges).select(F.col("node").alias("rep"), "component")
    final = stage(final.join(reps.select("rep", *names), "rep"), "final")
    lows = final.groupBy("component").agg(*(F.min(c).alias(f"least_{c}") for c in names))
    lows = final.select("rep", "component").join(lows, "component").drop("component")
    return reps.join(lows, "rep", "left").select("set_key", *(F.coalesce(f"least_{c}", c).alias(c) for c in names))


def _labels(signs: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges).select(F.col("node").alias("rep"), "component")
    return stage(signs.select("rep").join(found, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")), "labels")


def _star_links(members, labels, signs, sets, p, turn) -> DataFrame:
    """Confirmed links (a, b) of members with the best pivot of their buckets.

    A bucket's pivot is its smallest member in the first round, later one by a salted order.
    """
    known = members.join(labels, "rep")
    order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    pivots = known.groupBy("key").agg(
        F.min_by(F.struct("rep", "component"), order).alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    pivots = pivots.filter("low <> high").select("key", F.col("pivot.rep").alias("pivot"), F.col("pivot.component").alias("at"))
    pairs = known.join(pivots, "key").filter("component <> at").select("rep", "pivot").distinct()
    other = signs.select(F.col("rep").alias("pivot"), F.col("packed").alias("packed_b"), F.col("n").alias("m"))
    pairs = pairs.join(signs, "rep").join(other, "pivot")
    pairs = pairs.filter(f"100 * least(n, m) >= {p.percent} * greatest(n, m)")
    pairs = pairs.select("rep", "pivot", _agree_column(p)("packed", "packed_b").alias("agree")).filter(F.col("agree") >= least_agreement(p))
    best = pairs.groupBy("rep").agg(F.max_by("pivot", F.struct("agree", -F.col("pivot"))).alias("pivot"))
    far = sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("shingles_b"))
    both = best.join(sets, "rep").join(far, "pivot")
    return both.filter(_linked(p)("shingles", "shingles_b")).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))


def _loose(groups: DataFrame, signs: DataFrame, p: NearDup) -> DataFrame:
    """Spanning edges (a, b) that tie together at least all members of a bucket whose bits are close.

    Where more than ``few_rows`` members are outside the bucket's largest component, all of the bucket are tied.
    """
    sizes = groups.groupBy("key", "component").agg(F.count("*").alias("rows"), F.min("rep").alias("hub"))
    sizes = sizes.groupBy("key").agg((F.sum("rows") - F.max("rows")).alias("rest"), F.min("hub").alias("hub"))
    many = stage(sizes.filter(F.col("rest") > p.few_rows).select("key", "hub"), "many")
    few = sizes.filter((F.col("rest") > 0) & (F.col("rest") <= p.few_rows)).select("key")
    loads = signs.select("rep", F.col("packed").alias("load"), F.lit(0).alias("weight"))
    close = _blocks(groups.join(few, "key"), loads, p, _close_by_bits(p))
    return close.union(groups.join(many, "key").select(F.col("hub").alias("a"), F.col("rep").alias("b")))


def _tied(clusters: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Clusters (key, rep, component) cut into groups that hold every pair of different components at the threshold.

    Shingles are ordered by the number of sets that hold them.  Of two sets at the threshold with n <= m shingles, the
    first ``n - 2 * percent * n / (100 + percent) + 1`` of the smaller and the first ``m - percent * m / 100 + 1`` of the
    larger one share a shingle.  So members meet at a shingle only if it is among the first of one by the shorter bound.
    """
    def spelled(batches):
        for batch in batches:
            parts = _views(batch.column(1))
            count = np.array([len(x) for x in parts], np.int64)
            grams = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.int64)
            columns = [np.repeat(batch.column(0).to_numpy(), count), np.repeat(count, count), grams]
            for low in range(0, len(grams), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + (1 << 18)]) for c in columns], ["rep", "n", "gram"])

    own = sets.join(clusters.select("rep"), "rep", "left_semi").select("rep", "shingles")
    grams = stage(own.mapInArrow(spelled, "rep long, n long, gram long"), "grams")
    common = grams.groupBy("gram").agg(F.count("*").alias("held")).filter("held > 1")
    shared = grams.hint("merge").join(common, "gram").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("held", "gram"))).getField("gram").alias("grams"))
    ceil = lambda top, under: F.expr(f"({top} * n + {under} - 1) div {under}")
    lone = F.col("n") - F.size("grams")  # shingles of this set alone come first
    longer = F.col("n") - ceil(p.percent, 100) + 1 - lone
    shorter = F.col("n") - ceil(2 * p.percent, 100 + p.percent) + 1 - lone
    shared = shared.select("rep", "grams", longer.cast("int").alias("longer"), shorter.cast("int").alias("shorter")).filter("longer > 0")
    posts = shared.select("rep", "shorter", F.posexplode(F.expr("slice(grams, 1, longer)")).alias("at", "gram"))
    posts = posts.select("rep", "gram", (F.col("at") < F.col("shorter")).alias("first"))
    posts = stage(posts.join(clusters, "rep").select("key", "gram", "rep", "component", "first"), "posts")
    meets = posts.groupBy("key", "gram").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.max("first").alias("first"), F.min("rep").alias("hub")
    )
    ties = posts.hint("merge").join(meets.filter("low <> high and first").select("key", "gram", "hub"), ["key", "gram"])
    groups = components(ties.select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    return clusters.drop("key").join(groups.select(F.col("node").alias("rep"), F.col("component").alias("key")), "rep").select("key", "rep", "component")


def _blocks(groups: DataFrame, loads: DataFrame, p: NearDup, close) -> DataFrame:
    """Spanning edges of what ``close`` finds between members of different components of a group.

    The largest component of a group is never compared with itself: the rest of the members is
    compared with all, both cut into blocks of ``block_rows`` members or ``block_shingles`` weight.
    """
    sizes = groups.groupBy("key", "component").agg(F.count("*").alias("rows"))
    main = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("rows", "component")).alias("main"), F.max("rows").alias("most"),
        F.sum("rows").alias("all_rows"), F.count("*").alias("parts"),
    ).filter("parts > 1").drop("parts")
    rows = stage(groups.join(main, "key").join(loads, "rep"), "rests")
    weights = rows.groupBy("key").agg(
        F.sum("weight").alias("all_weight"), F.sum(F.when(F.col("component") != F.col("main"), F.col("weight")).otherwise(0)).alias("rest_weight")
    )
    cut = lambda count, weight: F.ceil(F.greatest(F.col(count) / p.block_rows, F.col(weight) / p.block_shingles, F.lit(1.0))).cast("int")
    rows = rows.withColumn("rest_rows", F.col("all_rows") - F.col("most")).join(weights, "key")
    rows = rows.withColumn("n_all", cut("all_rows", "all_weight")).withColumn("n_rest", cut("rest_rows", "rest_weight"))
    spot = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    every = rows.select(
        "key", "rep", "component", "load", F.lit(False).alias("rest"),
        spot("n_all", 1).alias("x"), F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)).alias("y"),
    )
    rest = rows.filter("component <> main").select(
        "key", "rep", "component", "load", F.lit(True).alias("rest"),
        F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("x"), spot("n_rest", 2).alias("y"),
    )
    tasks = every.unionByName(rest).select(F.xxhash64("key", "x", "y").alias("task"), "rep", "component", "load", "rest")

    def run(table: pa.Table):
        is_rest = table["rest"].to_numpy(zero_copy_only=False)
        rep, component = table["rep"].to_numpy(), table["component"].to_numpy()
        left, right = np.flatnonzero(is_rest), np.flatnonzero(~is_rest)
        if len(left) and len(right):
            yield from _span(left, right, rep, component, close(table["load"].to_pylist(), left, right))

    return by_key(tasks, "task", run, "a long, b long").distinct()


def _span(left, right, rep, component, rows):
    """Edges that join components, one for each join: a spanning forest of the close pairs."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    for i, near in zip(left, rows, strict=True):
        at = right[near]
        at = at[component[at] != component[i]]
        _, firsts = np.unique(component[at], return_index=True)
        for j in at[firsts].tolist():
            x, y = find(int(component[i])), find(int(component[j]))
            if x != y:
                parent[x] = y
                yield {"a": int(rep[i]), "b": int(rep[j])}


def _close_by_bits(p: NearDup):
    least = least_agreement(p)

    def close(loads, left, right):
        bits = np.frombuffer(b"".join(loads), np.uint64).reshape(len(loads), -1)
        others = bits[right]
        for i in left:
            yield np.flatnonzero(agreement(bits[i], others, p.bits) >= least)

    return close


def _close_by_sets(p: NearDup):
    def close(loads, left, right):
        parts = [np.frombuffer(x, np.uint64) for x in loads]
        size = np.array([len(x) for x in parts])
        names, ids = np.unique(np.concatenate(parts), return_inverse=True)
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        flat = np.concatenate([ids[at[j] : at[j + 1]] for j in right])
        begin = np.zeros(len(right), np.int64)
        np.cumsum(size[right][:-1], out=begin[1:])
        marked = np.zeros(len(names), np.int32)
        for i in left:
            own = ids[at[i] : at[i + 1]]
            marked[own] = 1
            both = np.add.reduceat(marked[flat], begin)
            marked[own] = 0
            yield np.flatnonzero(100 * both >= p.percent * (size[i] + size[right] - both))

    return close
