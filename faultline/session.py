"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # ids seen by a stream live on disk, not in the executors' heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A local session that names none, as in tests, uses its warehouse folder.  On a cluster that
    is refused, since executors could not see each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/faultline/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several branches read, and go on from the written table.

    Each branch would otherwise compute it again.  The table survives lost executors and
    gives the planner a true size.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PLAIN_KEYS = 100_000  # hashes that are broadcast as they are; a table of them takes some 100 bytes each in the driver
BROADCAST_KEYS = 64_000_000  # hashes that are broadcast as bits
MOST_BITS = 1 << 28  # 32 MB
_ROW_WORDS = 64  # words of 64 bits in a row of the table of bits


def at_most(rows: DataFrame, most: int) -> bool:
    """Whether there are no more than ``most`` rows; stops counting there."""
    return rows.limit(most + 1).count() <= most


def sieve(rows: DataFrame, asked: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``rows`` without most of those whose keys are not in ``asked``, before they are shuffled; an exact join must follow.

    ``keys`` maps columns of ``rows`` to those of ``asked``.  The hashes of the asked keys are written, and broadcast if
    they are few enough, many of them as the bits that they set; rows that only share a hash or a bit stay.
    """
    hashes = stage(asked.select(F.xxhash64(*keys.values()).alias("_asked")).distinct(), "asked")
    count = hashes.count()
    if count > BROADCAST_KEYS:
        return rows
    if count <= PLAIN_KEYS:
        return rows.join(F.broadcast(hashes), F.xxhash64(*keys) == F.col("_asked"), "left_semi")
    size = 64 * _ROW_WORDS
    lots = max(1, min(1 << (16 * count - 1).bit_length(), MOST_BITS) // size)  # 16 bits for each hash, as long as that fits
    lot, word, bit = _spot(F.xxhash64(*keys), lots)
    marks = F.broadcast(_bits(hashes, lots))
    return rows.join(marks, (lot == F.col("_lot")) & (F.getbit(F.get("_bits", word), bit) == 1), "left_semi")


def _spot(hashed: Column, lots: int) -> tuple[Column, Column, Column]:
    """Row, word in the row and bit in the word of a hash."""
    return F.pmod(hashed, F.lit(lots)), F.shiftright(hashed, 46).bitwiseAND(_ROW_WORDS - 1).cast("int"), F.shiftright(hashed, 40).bitwiseAND(63).cast("int")


def _bits(hashes: DataFrame, lots: int) -> DataFrame:
    """(_lot, _bits) with the bits that the hashes set; lots without any have no row."""
    lot, word, bit = _spot(F.col("_asked"), lots)
    spots = hashes.select(lot.alias("_lot"), word.alias("word"), bit.alias("bit")).repartition("_lot")  # dealt once, for both sums
    words = spots.groupBy("_lot", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    found = words.groupBy("_lot").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    every = F.transform(F.sequence(F.lit(0), F.lit(_ROW_WORDS - 1)), lambda w: F.coalesce(F.try_element_at("found", w), F.lit(0).cast("long")))
    return found.select("_lot", every.alias("_bits"))


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a table scan over all cores, where the scan alone keeps less than half of them busy.

    A few large row groups are a few tasks, however small the splits are planned.  The tasks that get rows are counted
    from the files' footers; a scan of many row groups comes back as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    busy = scan.select(F.spark_partition_id().alias("task")).distinct().count()
    return scan if 2 * busy >= cores else scan.repartition(2 * cores)
