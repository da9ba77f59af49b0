"""The pipeline's stages, each on its own input, against plain Python."""

from collections import Counter

import brute
import corpus_pipeline as pipe
from pyspark.sql import functions as F

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {}
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, sf).cache()
        rows, before = out.collect(), docs.collect()
        texts[name] = Counter(r.doc_id for r in rows)
        if name != "shard":
            assert out.columns == NAMES
        if name == "quality_rules":
            failed = {r.doc_id for r in before if (c := brute.base_counts(r.text))[0] < 10 or 100 * c[4] > 20 * c[0]}
            assert not failed & set(texts[name]) and len(rows) > 0.7 * len(before)
        elif name == "near_dedup":
            wanted = {d for d, (_, low) in brute.near([(r.doc_id, r.text) for r in before], 5).items() if d == low}
            assert set(texts[name]) == wanted
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            found = brute.contamination([(r.doc_id, r.text) for r in before], items)
            assert set(texts[name]) == {r.doc_id for r, (n, hit, _) in zip(before, found, strict=True) if not (hit and 20 * hit >= n)}
        elif name == "mix":
            assert max(texts[name].values()) <= 2 and set(texts[name]) <= {r.doc_id for r in before}
            words = lambda rs: sum(len(brute.WORD.findall(r.text)) for r in rs)
            assert 1.3 < words(rows) / words(before) < 1.7
        else:
            assert texts[name] == Counter(r.doc_id for r in before)
            by_text = out.groupBy("text").agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0]
            slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d")).collect()
            assert by_text == 1 and all(r.n == r.d == r.top + 1 for r in slots)
        docs = out
    assert pipe.run(spark, sf).count() == sum(texts["shard"].values())


def test_odd_rows_pass_every_stage(spark, odd_texts, sf):
    rows = [(k, t, None, None if k % 4 else "s", None) for k, t in enumerate(odd_texts)] + [(None, odd_texts[8], None, None, 3), (8, odd_texts[8], None, "s", None), (8, odd_texts[12], None, "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    counts = {name: stage(spark, docs, sf).count() for name, stage in pipe.STAGES}
    assert counts["shard"] == len(rows) and counts["decontaminate"] == len(rows)
    left = pipe.near_duplicates(spark, docs, sf).collect()
    assert Counter(r.doc_id for r in left)[8] == 2 and None not in {r.doc_id for r in left}
    for name, stage in pipe.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_repeated_id_loses_its_copies_only(spark, sf):
    """Id 5 holds a near copy of row 1 and a text of its own; id 7 copies that text."""
    first, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, first), (5, first + " end"), (5, other), (7, other), (7, "words that no other row has at all")]
    docs = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA)
    left = pipe.near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([rows[0], rows[2], rows[4]])


def test_sources_of_long_documents_meet_their_targets(spark, sf):
    """About one document to a shard: source c is to give three quarters of its words."""
    rows = [(d, " ".join([f"w{d}"] * 2000), None, "a" if d < 100 else "b" if d < 150 else "c", None) for d in range(200)]
    out = pipe.mixed(spark, spark.createDataFrame(rows, SCHEMA), sf).groupBy("source").count().collect()
    words = {r.source: 2000 * r["count"] for r in out}
    assert all(abs(words.get(s, 0) - target) <= 3000 for s, target in (("a", 375_000), ("b", 150_000), ("c", 75_000)))


def test_rows_without_id_lose_their_copies(spark, sf):
    """Of exact and near copies one stays, with an id if any has one; so does every row with neither id nor words."""
    first, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(None, first), (None, first), (None, first + " end"), (3, other), (None, other), (None, other), (4, other + " end"), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA)
    left = [(r.doc_id, r.text) for r in pipe.near_duplicates(spark, docs, sf).collect()]
    assert len(left) == 4 and left.count((None, None)) == 2 and (3, other) in left and left.count((None, first)) + left.count((None, first + " end")) == 1


def test_columns_of_any_name_pass_every_stage(spark, sf):
    names = ["row_key", "row_key_", "copy", "copies", "spot", "Size", "shard", "slot", "law", "text_crc32", "order", "piece"]
    rows = [(d, " ".join(f"w{d}x{k}" for k in range(40 + d)), "en", f"s{d % 2}", 7, *(f"{n}{d}" for n in names)) for d in range(30)]
    docs = spark.createDataFrame([*rows, rows[3]], SCHEMA + "".join(f", {n} string" for n in names))
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, sf)
        shown = {n: f"input_{n.lower()}" if name == "shard" and n.lower() in pipe.PLACES else n for n in names}
        assert set(out.columns) == {*NAMES, *shown.values(), *(pipe.PLACES if name == "shard" else ())}
        found = out.collect()
        assert len(found) >= 25 and all(r[shown[n]] == f"{n}{r.doc_id}" for r in found for n in names), name
