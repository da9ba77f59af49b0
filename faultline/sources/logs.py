"""Log lines: reading, slicing to the latest run, labelling with run ids, look-ahead.

A log is ``(run_key, line_no, line)``; ``line_no`` rises within a key and may have gaps.
Nothing here sorts a whole log in one task: ordered work runs inside blocks of line
numbers, and only one summary row per block is ever ordered across a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..session import stage
from . import commits

BLOCK_LINES = 1 << 18
BROADCAST_SPLITS = 100_000  # rows of some 200 bytes
LOOKAHEAD = 6  # the longest reference pattern has seven words, so six lines can follow
# what a following line can add to an open match: a few words and one parenthesis
_HEAD = r"(?U)\A(?:[\w.$'\"`-]+\s*){0,7}(?:\([^)\n]*\)?)?"


def read_logs(spark: SparkSession, path: str, key_pattern: str = r"([^/]+?)(?:\.[^./]*)?\z") -> DataFrame:
    """(run_key, line_no, line) of every text file; group 1 of ``key_pattern`` on its path is the key.

    Files are split as Spark splits any text file; lines end at line feeds, carriage returns or both.  Lines of a split
    are numbered by their place in its task, and the splits' line counts, one row each, give every split its first
    number.  So no line is shuffled or sorted; the counts are broadcast while they are few.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = raw.groupBy("file", "split").agg(F.count("*").alias("count"), F.min("place").alias("first"))
    starts = stage(counts.select("file", "split", "first", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")), "splits")
    few = starts.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    # both scans deal the splits out alike; a line whose task is not that of its split's count must not get a wrong number
    same_task = F.shiftright("place", 33) == F.shiftright("first", 33)
    number = F.when(same_task, F.col("start") + F.col("place") - F.col("first")).otherwise(F.raise_error(F.lit("splits were dealt out anew")).cast("long"))
    return raw.join(F.broadcast(starts) if few else starts, ["file", "split"]).select(
        F.regexp_extract("file", key_pattern, 1).alias("run_key"), number.alias("line_no"), "line"
    )


def is_separator(line: Column) -> Column:
    return F.contains(line, F.lit("=" * 30)) & F.contains(line, F.lit("|"))


def separator_id(line: Column) -> Column:
    field = F.element_at(F.split(line, r"\|", -1), 2)
    return T.strip(F.replace(field, F.lit("="), F.lit("")))


def run_ids(lines: DataFrame) -> DataFrame:
    """(run_key, run_id, line_no): every separator, at the last place it occurs."""
    return (
        lines.filter(is_separator(F.col("line")))
        .groupBy("run_key", separator_id(F.col("line")).alias("run_id"))
        .agg(F.max("line_no").alias("line_no"))
    )


def new_run_ids(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ids of this log that the ledger does not hold yet, each once."""
    return run_ids(lines).join(ledger.select("run_key", "run_id"), ["run_key", "run_id"], "left_anti")


LEDGER = "run_key string, run_id string, seq struct<batch: long, line_no: long>"


def append_ledger(new_ids: DataFrame, path: str, batch: int) -> None:
    """Append ids; ``batch`` rises with every append, whatever lines the ids stood on.

    The append of a batch that is run again, after whatever failure, leaves its ids there once.
    """
    seq = F.struct(F.lit(batch).cast("long").alias("batch"), F.col("line_no").cast("long").alias("line_no"))
    commits.append(new_ids.select("run_key", "run_id", seq.alias("seq")), path, batch)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(run_key, run_id, seq) of all appends."""
    return commits.read(spark, path, LEDGER)


def latest_ids(ledger: DataFrame) -> DataFrame:
    """The id appended last per key; ``seq`` gives the append order, as (batch, line_no) or one number."""
    return ledger.groupBy("run_key").agg(F.max_by("run_id", "seq").alias("run_id"))


def slice_starts(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """(run_key, start_line): first line that contains the key's latest id.

    The per-key aggregate is combined before the shuffle, so a hot key costs one row per
    task rather than its whole log.
    """
    return (
        lines.join(latest_ids(ledger), "run_key")
        .filter(F.contains("line", "run_id"))
        .groupBy("run_key")
        .agg(F.min("line_no").alias("start_line"))
    )


def latest_slice(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Lines from the latest run on, stripped, blank ones dropped."""
    return (
        lines.join(slice_starts(lines, ledger), "run_key")
        .filter(F.col("line_no") >= F.col("start_line"))
        .select("run_key", "line_no", T.strip(F.col("line")).alias("line"))
        .filter(F.col("line") != "")
    )


def _blocked(lines: DataFrame, block_lines: int) -> DataFrame:
    return lines.withColumn("block", F.expr(f"line_no div {block_lines}"))


def segment_runs(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Give each line the id of the separator at or above it; null before the first one."""
    found = F.when(is_separator(F.col("line")), separator_id(F.col("line")))
    marked = _blocked(lines, block_lines).withColumn("found", found)
    inside = Window.partitionBy("run_key", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("run_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        marked.groupBy("run_key", "block")
        .agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.col("line_no"))).alias("last_found"))
        .select("run_key", "block", F.last("last_found", ignorenulls=True).over(across).alias("carried"))
    )
    return (
        marked.withColumn("run_id", F.last("found", ignorenulls=True).over(inside))
        .join(carry, ["run_key", "block"], "left")
        .select("run_key", "line_no", "line", F.coalesce("run_id", "carried").alias("run_id"))
    )


def with_lookahead(lines: DataFrame, keep: Column, block_lines: int = BLOCK_LINES, head: str = _HEAD) -> DataFrame:
    """Non-blank lines where ``keep`` holds, plus ``ahead``: the heads of the next six lines.

    ``head`` is a pattern of what a match begun above can use up of a line.

    Patterns that allow any white space between words may run over line ends.  Only the
    kept lines travel whole; every other line is shuffled as the short head that a match
    begun above could still consume.
    """
    body = T.strip(F.col("line"))
    slim = _blocked(lines.filter(body != ""), block_lines).select(
        "run_key",
        "block",
        "line_no",
        F.when(keep, F.col("line")).alias("line"),
        F.regexp_extract(body, head, 0).alias("head"),
    )
    ordered = Window.partitionBy("run_key", "block").orderBy("line_no")
    next_blocks = Window.partitionBy("run_key").orderBy("block").rowsBetween(1, LOOKAHEAD)
    inside = slim.withColumn("after", F.collect_list("head").over(ordered.rowsBetween(1, LOOKAHEAD)))
    tops = (
        slim.withColumn("place", F.row_number().over(ordered))
        .filter(F.col("place") <= LOOKAHEAD)
        .groupBy("run_key", "block")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "head"))).alias("top"))
        .select("run_key", "block", F.flatten(F.collect_list(F.col("top.head")).over(next_blocks)).alias("below"))
    )
    heads = F.slice(F.concat("after", F.coalesce("below", F.array().cast("array<string>"))), 1, LOOKAHEAD)
    padded = F.slice(F.concat(heads, F.array_repeat(F.lit(""), LOOKAHEAD)), 1, LOOKAHEAD)
    return (
        inside.filter(F.col("line").isNotNull())
        .join(tops, ["run_key", "block"], "left")
        .select("run_key", "line_no", "line", F.array_join(padded, "\n").alias("ahead"))
    )
