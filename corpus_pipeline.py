"""From raw documents to sharded training rows: five stages, each written and read again.

Quality rules, near-duplicate removal, benchmark decontamination, mixing to target weights, sharding.
Rows are told apart by a key over id, text and source, so rows that share an id are judged singly.

Further columns of the input, whatever their names, go through every stage unchanged: names used inside are
chosen anew where the input has them.  The last stage adds columns; an input column of such a name is kept as
``input_<name>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from faultline.llm.decontaminate import decontaminate
from faultline.llm.mixing import WORD, placed, whole_copies
from faultline.llm.near_dedup import surplus_rows
from faultline.llm.quality_rules import keep_good
from faultline.llm.sharding import shard_documents
from faultline.llm.tables import BROADCAST_IDS, only_ids
from faultline.session import stage, work_dir

#: Line labelling and candidate search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def row_key() -> Column:
    return F.xxhash64("doc_id", "text", "source")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores added until the input has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their key, and the name of its column."""
    key = free_name(docs, "row_key")
    return docs.withColumn(key, row_key()), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, judged by its own text also if its id repeats; of rows equal in id, text and source one.

    The row that stays is the group's smallest by id; rows without an id come last.  Rows with neither id nor words all stay.
    """
    rows, key = keyed(docs)
    gone = stage(surplus_rows(rows, key), "gone")
    left = only_ids(rows, gone, key, "left_anti")
    alike = left.filter(F.col("doc_id").isNotNull() | F.col("text").rlike(WORD))
    again = stage(alike.groupBy(key).count().filter("count > 1").select(key), "again")
    if again.isEmpty():
        return left.select(docs.columns)
    spot = free_name(rows, "spot")
    first = F.row_number().over(Win.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
    one = only_ids(left, again, key).withColumn(spot, first).filter(F.col(spot) == 1)
    return only_ids(left, again, key, "left_anti").select(docs.columns).union(one.select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window contaminates."""
    rows, key = keyed(docs)
    found = decontaminate(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stage(found.filter("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return only_ids(rows, gone, key, "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, in whole documents; remainders are carried within a source."""
    rows, key = keyed(docs)
    times = free_name(rows, "copies")
    taken = whole_copies(placed(rows.select(key, "text", "source"), id_col=key))
    copies = stage(taken.filter("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").alias(times)), "copies")
    small = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(copies) if small else copies, key)
    return rows.withColumn(free_name(rows, "copy"), F.explode(F.sequence(F.lit(1), times))).select(docs.columns)


PLACES = ("size", "text_crc32", "law", "shard", "slot")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; rows of equal text share a shard.

    Adds size, text_crc32, law, shard and slot; input columns of these names are kept as ``input_<name>``.
    """
    for name in docs.columns:
        if name.lower() in PLACES:
            docs = docs.withColumnRenamed(name, free_name(docs, f"input_{name.lower()}"))
    rows, key = keyed(docs)
    nth = free_name(rows, "copy")
    places = shard_documents(rows.select(key, "text"), id_col=key).withColumnRenamed("doc_id", key)
    places = places.withColumn(nth, F.row_number().over(Win.partitionBy(key).orderBy("slot")))
    rows = rows.withColumn(nth, F.row_number().over(Win.partitionBy(key).orderBy(key)))
    return rows.join(places.select(key, nth, *PLACES), [key, nth]).drop(key, nth)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
