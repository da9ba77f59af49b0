"""Appends that survive a retry.

Rows are first written aside, as a part of their own, and only a complete part is published, by one small row that
names it.  Readers follow published rows alone, so what a killed job left behind is never seen; of two parts
published for one append the first counts, so an append that is run again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_part(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write ``rows`` as a new part of the table at ``path``; nobody reads it before it is published."""
    part = uuid.uuid4().hex
    rows.write.partitionBy(*partition_by).parquet(f"{path}/part={part}")
    return part


def publish(entries: DataFrame, path: str) -> None:
    """Make parts known; an entry is one row in one file, so it appears whole or not at all."""
    entries.write.mode("append").parquet(path)


def published(df: DataFrame) -> DataFrame:
    """Entries read from files, with the time at which each was published."""
    return df.select("*", F.unix_micros(F.col("_metadata.file_modification_time")).alias("published"))


def first_published(entries: DataFrame, *keys: str) -> DataFrame:
    """Of the entries with equal ``keys`` the first one."""
    others = [c for c in entries.columns if c not in keys]
    order = F.struct("published", "part")
    return entries.groupBy(*keys).agg(*(F.min_by(c, order).alias(c) for c in others))


def append(rows: DataFrame, table: str, key: int) -> None:
    """Append ``rows`` as append number ``key``; running it again, whenever it failed, appends them once."""
    part = write_part(rows, f"{table}/parts")
    entry = rows.sparkSession.range(1).select(F.lit(key).cast("long").alias("key"), F.lit(part).alias("part"))
    publish(entry, f"{table}/entries")


def read(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of all published appends."""
    entries = published(spark.read.schema("key long, part string").parquet(f"{table}/entries"))
    known = first_published(entries, "key").select("part")
    stored = spark.read.schema(f"{schema}, part string").parquet(f"{table}/parts")
    return stored.join(known, "part", "left_semi").drop("part")
