"""Top-k retrieval of chunks, by words or by vectors, for many texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import chunks as C
from ..functions import vectors as V
from ..settings import LIMITS


def chunk_rows(texts: DataFrame, key: str = "key") -> DataFrame:
    """(key, seq, title, body, priority, score) of ``texts(key, text, signals)``."""
    made = texts.select(key, "signals", F.inline(C.sql_chunks(F.col("text"), F.col("signals"))))
    return made.select(
        key, "seq", "title", "body", "priority",
        C.chunk_score(F.col("body"), F.col("priority"), F.col("signals")).alias("score"),
    )


def lexical_top_k(rows: DataFrame, key: str = "key", k: int = LIMITS.top_chunks) -> DataFrame:
    """Best k rows per key.  Spark cuts each partition to k per key before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "seq")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_top_rows(texts: DataFrame, key: str = "key", k: int = LIMITS.top_chunks) -> DataFrame:
    """(key, seq, title, body, score, rank): the best k chunks of ``texts(key, text, signals)``.

    Ranked inside the row: neither texts nor chunks are shuffled.
    """
    top = C.lexical_ranked(C.sql_chunks(F.col("text"), F.col("signals")), F.col("signals"), k)
    rows = texts.select(key, F.posexplode(top).alias("place", "c"))
    return rows.select(key, "c.seq", "c.title", "c.body", (-F.col("c.order")).alias("score"), (F.col("place") + 1).alias("rank"))


@F.pandas_udf(DoubleType())
def squared_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact squared L2 distance of whole Arrow batches, in doubles."""
    if not len(a):
        return pd.Series([], dtype=float)
    gap = np.stack(a).astype(np.float64) - np.stack(b).astype(np.float64)
    return pd.Series((gap * gap).sum(1))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = LIMITS.top_chunks) -> DataFrame:
    """(key, seq, distance, rank): the k nearest chunk vectors of each key's one query.

    ``vectors(key, seq, embedding)``, ``queries(key, query)``.  Every vector meets exactly
    one query, so work is linear; the window keeps k rows per key and partition before it
    shuffles, so a key that owns most vectors stays spread out.
    """
    order = Window.partitionBy("key").orderBy("distance", "seq")
    return (
        vectors.join(queries, "key")
        .select("key", "seq", squared_distance(F.col("embedding"), F.col("query")).alias("distance"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def chunk_vectors(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, seq, embedding) of the chunks in ``rows(key, seq, body)``."""
    return rows.select(F.col(key).alias("key"), "seq", V.text_vectors(F.col("body")).alias("embedding"))


def with_nearest_chunks(df: DataFrame, chunks: str, asked: str, out: str, k: int = LIMITS.top_chunks) -> DataFrame:
    """Add ``out``, array<struct<title, body>>: the k chunks of a row nearest to its ``asked`` text, ties in chunk order.

    Vectors are made and compared inside the row; nothing is shuffled.  Null chunks give null.
    """
    far = V.squared_distances(F.transform(chunks, lambda c: c["body"]), F.col(asked))
    near = F.array_sort(F.transform(
        F.arrays_zip(F.col(chunks).alias("c"), F.col("_far").alias("far")),
        lambda z: F.struct(z["far"].alias("far"), z["c"]["seq"].alias("seq"), z["c"]["title"].alias("title"), z["c"]["body"].alias("body")),
    ))
    top = F.transform(F.slice(near, 1, k), lambda c: F.struct(c["title"].alias("title"), c["body"].alias("body")))
    return df.withColumn("_far", far).withColumn(out, F.when(F.col(chunks).isNotNull(), top)).drop("_far")


def choose_retrieval(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """(key, mode, rank, seq): vector hits where a key has them, lexical hits elsewhere."""
    have = vector.select("key").distinct()
    plain = lexical.join(have, "key", "left_anti").select("key", F.lit("lexical").alias("mode"), "rank", "seq")
    return vector.select("key", F.lit("vector").alias("mode"), "rank", "seq").unionByName(plain)
