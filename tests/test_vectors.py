"""Text vectors against a plain computation, and retrieval by them."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from faultline.functions import vectors as V
from faultline.operators import retrieve


def plain(text):
    counts = Counter(re.findall(r"[0-9A-Za-z_\x80-\U0010FFFF]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
    total = [0.0] * 64
    for word, n in counts.items():
        number = int(hashlib.md5(word.encode()).hexdigest()[:16], 16)
        for d in range(64):
            total[d] += (1 + math.log(n)) * (1 if number >> d & 1 else -1)
    length = math.sqrt(sum(x * x for x in total))
    return [x / length if length else 0.0 for x in total]


def test_vectors_of_texts(spark):
    texts = ["select a, b from t where a = b and a > 0", "", None, "   ,;", "Été été ÉTÉ x_1 X_1", "w " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", V.text_vectors(F.col("t")).alias("v")).collect()
    for r in rows:
        assert np.allclose(r["v"], plain(texts[r["n"]]))
    assert V.text_vector("a b") @ V.text_vector("b a") > 1 - 1e-9


def test_texts_that_share_words_are_nearer(spark):
    asked = "revenue by customer and month"
    bodies = ["sum of revenue for each customer", "month and customer keys of revenue", "create index on disk pages", "", "revenue by customer and month"]
    chunks = [(n, f"C{n}", b) for n, b in enumerate(bodies)]
    schema = "asked string, chunks array<struct<seq: int, title: string, body: string>>"
    df = spark.createDataFrame([(asked, chunks), (asked, []), (asked, None), (None, chunks)], schema)
    got = [r["near"] for r in retrieve.with_nearest_chunks(df, "chunks", "asked", "near", 3).collect()]
    assert [c["title"] for c in got[0]] == ["C4", "C1", "C0"] and got[1] == [] and got[2] is None
    assert [c["title"] for c in got[3]][0] == "C3"  # no words asked for: the text without words is nearest


def test_chunk_vectors_go_into_the_search_by_keys(spark):
    rows = spark.createDataFrame([("k", 0, "alpha beta"), ("k", 1, "beta gamma"), ("k", 2, "delta"), ("q", 0, "alpha")], "key string, seq int, body string")
    asked = spark.createDataFrame([("k", "gamma beta"), ("q", "x")], "key string, t string").select("key", V.text_vectors(F.col("t")).alias("query"))
    got = retrieve.vector_top_k(retrieve.chunk_vectors(rows), asked, 2).collect()
    assert sorted((r["key"], r["rank"], r["seq"]) for r in got) == [("k", 1, 1), ("k", 2, 0), ("q", 1, 0)]
