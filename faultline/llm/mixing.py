"""Mixing of sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Targets: the sources share ``percent`` of all words by weight, no source above ``passes`` times its
own size; what a source cannot take is shared by weight among the rest (water filling, in closed form).

Blocks: every target is a number of equal blocks of words.  Quotas are the highest-quotient
(Sainte-Lague) allocation, first over sources, then over each source's shards.  The allocation is
reached from plain rounding, which is the same rule at one fixed divisor, by granting or taking back the few
seats that are over or missing; so no table of all seats is made.

Selection: a shard's documents lie end to end in a seeded order and are cut into blocks; a quota of
q out of n blocks takes all of them q div n times, and q mod n from a seeded block on, around the end.  Word
positions come from sums of pieces, so no source or shard is ever one task.

Defined results: null text has size 0 and takes nothing; rows without a source form the last source;
equal rows are told apart by position only; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from faultline.session import stage


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)  # repeated over the sources in code point order
    percent: int = 150
    passes: int = 2
    shards: int = 64
    fineness: int = 128  # blocks in a shard of the smallest target
    most_words: int = 4096  # in a block
    piece_words: int = 1 << 20
    seed: int = 20


WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["no_source", "source_key"]
CELL = [*SOURCE, "shard"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, p: Mix) -> DataFrame:
    """(no_source, source_key, source_size) plus the target of each source."""
    by_name = Win.orderBy("no_source", "source_key")
    ranked = sizes.withColumn("weight", F.get(F.array(*map(F.lit, p.weights)), (F.row_number().over(by_name) - 1) % len(p.weights)))
    ranked = ranked.withColumn("most", F.col("source_size") * p.passes).withColumn("level", F.col("most") / F.col("weight"))
    by_level = Win.orderBy("level", "no_source", "source_key")
    before, everything = by_level.rowsBetween(Win.unboundedPreceding, -1), by_level.rowsBetween(Win.unboundedPreceding, Win.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    left = F.sum("source_size").over(everything) * (p.percent / 100) - zero(F.sum("most").over(before))
    ranked = ranked.withColumn("rate", left / (F.sum("weight").over(everything) - zero(F.sum("weight").over(before))))
    rate = F.first(F.when(F.col("rate") <= F.col("level"), F.col("rate")), ignorenulls=True).over(everything)
    target = F.least(F.col("most").cast("double"), F.coalesce(rate, F.lit(0.0)) * F.col("weight"))
    return ranked.select(*SOURCE, "source_size", target.alias("target"))


def apportion(cells: DataFrame, group: list[str], name: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: each group's number of ``seats`` shared over its rows by Sainte-Lague.

    ``weight`` is a row's share of the group's seats as a real number of seats; the divisor is then 1.
    """
    rounded = cells.withColumn(out, F.floor(F.col(weight) + 0.5))
    within = Win.partitionBy(*group) if group else Win.partitionBy(F.lit(0))
    rounded = rounded.withColumn("gap", (F.col(seats) - F.sum(out).over(within)).cast("int"))
    step = F.explode_outer(F.when(F.col("gap") != 0, F.sequence(F.lit(1), F.abs("gap"))))
    offers = rounded.filter("gap <> 0").select(*dict.fromkeys([*group, *name]), "gap", weight, out, step.alias("k"))
    offers = offers.filter(f"gap > 0 or {out} >= k")
    quotient = F.when(F.col("gap") > 0, -F.col(weight) / (2 * (F.col(out) + F.col("k")) - 1)).otherwise(
        F.col(weight) / (2 * (F.col(out) - F.col("k")) + 1)
    )
    best = within.orderBy(quotient, *name, "k")
    moved = offers.withColumn("place", F.row_number().over(best)).filter("place <= abs(gap)")
    moved = moved.groupBy(*dict.fromkeys([*group, *name])).agg(F.sum(F.signum("gap")).cast("long").alias("moved"))
    joined = rounded.drop("gap").join(moved, list(dict.fromkeys([*group, *name])), "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("moved", F.lit(0))).drop("moved")


def mix(docs: DataFrame, p: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    return placed(docs, p, id_col, text_col, source_col).drop(*SOURCE)


def placed(docs: DataFrame, p: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``mix`` with their source."""
    order = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(p.seed))  # rows that share an id, or have none, spread by their texts
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"), word_count(F.col(text_col)).alias("size"),
        order.alias("order"), F.pmod(order, F.lit(p.shards)).cast("int").alias("shard"),
    )
    sized = stage(sized, "sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    pieces = 1 + int(total) // (p.shards * p.piece_words)
    piece = F.pmod(F.xxhash64("order", F.lit(p.seed + 1)), F.lit(pieces)).cast("int")
    sized = sized.withColumn("piece", piece)
    sums = stage(sized.groupBy(*CELL, "piece").agg(F.sum("size").alias("words")), "pieces")
    cells = sums.groupBy(*CELL).agg(F.sum("words").alias("cell_size"))
    sources = targets(cells.groupBy(*SOURCE).agg(F.sum("cell_size").alias("source_size")), p)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Win.partitionBy(F.lit(0)))
    block = F.greatest(F.lit(1), F.least(F.lit(p.most_words), F.floor(smallest / (p.shards * p.fineness)))).cast("long")
    sources = sources.withColumn("block", F.coalesce(block, F.lit(1)))
    sources = sources.withColumn("ideal", F.col("target") / F.col("block"))
    sources = sources.withColumn("seats", F.round(F.sum("ideal").over(Win.partitionBy(F.lit(0)))).cast("long"))
    sources = stage(apportion(sources, [], SOURCE, "ideal", "seats", "quota").drop("ideal", "seats"), "quotas")
    cells = cells.join(sources, SOURCE).withColumn("ideal", F.when(F.col("source_size") > 0, F.col("quota") * F.col("cell_size") / F.col("source_size")).otherwise(0.0))
    cells = apportion(cells, SOURCE, ["shard"], "ideal", "quota", "cell_quota")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("cell_size") / F.col("block"))).cast("long")
    cells = cells.withColumn("blocks", blocks).withColumn("cell_quota", F.least("cell_quota", F.col("blocks") * p.passes))
    cells = cells.withColumn("begin", F.pmod(F.xxhash64(*CELL, F.lit(p.seed + 2)), F.col("blocks")))
    before = Win.partitionBy(*CELL).orderBy("piece").rowsBetween(Win.unboundedPreceding, -1)
    spots = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).join(cells.drop("ideal", "quota"), CELL)
    lined = Win.partitionBy(*CELL, "piece").orderBy("order", "doc_id", "size").rowsBetween(Win.unboundedPreceding, Win.currentRow)
    lines = sized.withColumn("reach", F.sum("size").over(lined)).join(stage(spots, "spots"), [*CELL, "piece"])
    high = F.col("offset") + F.col("reach")
    low = high - F.col("size")
    extra = F.col("cell_quota") % F.col("blocks")
    inside = lambda a, b: F.greatest(F.lit(0), F.least(high, b) - F.greatest(low, a))
    taken = F.floor(F.col("cell_quota") / F.col("blocks")) * F.col("size")
    taken = taken + inside(F.col("begin") * F.col("block"), (F.col("begin") + extra) * F.col("block"))
    taken = taken + inside(F.lit(0), (F.col("begin") + extra - F.col("blocks")) * F.col("block"))
    return lines.select(*SOURCE, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def whole_copies(taken: DataFrame) -> DataFrame:
    """doc_id and copies: words taken as whole documents, with the remainder carried to the source's next document.

    Only documents that an end of their shard's run cuts have a remainder, a few for each shard.  They follow each
    other by size, so a source is off by at most half of its largest such document.
    """
    rows = taken.filter("size > 0").groupBy(*SOURCE, "doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    rows = stage(rows.selectExpr(*SOURCE, "doc_id", "size", "taken div size as copies", "taken % size as rest"), "taken")
    line = Win.partitionBy(*SOURCE).orderBy(F.desc("size"), "doc_id")
    reach = F.sum(F.col("rest") / F.col("size")).over(line.rowsBetween(Win.unboundedPreceding, Win.currentRow))
    cut = rows.filter("rest > 0").withColumn("mark", F.floor(reach + 0.5))
    cut = cut.select("doc_id", (F.col("copies") + F.col("mark") - F.lag("mark", 1, 0).over(line)).cast("int").alias("copies"))
    return rows.filter("rest = 0").select("doc_id", F.col("copies").cast("int").alias("copies")).union(cut)
