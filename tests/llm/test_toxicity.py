"""The toxicity classifier: its risk against numerical slopes, its scores against plain Python, its aim on held-out rows."""

import math
import random
import zlib
from itertools import pairwise

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import toxicity
from faultline.llm import words as W
from faultline.llm.toxicity import PosUnl, risk, score, train

INSULTS = ["foulword", "nastyname", "rottenslur", "vileterm"]
SMALL = PosUnl(members=2, positives=300, unlabelled=500)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus():
    """1,200 texts, every eighth with an insult; a twentieth of the rest is called toxic wrongly; half have labels."""
    rng, docs, labels = random.Random(3), [], []
    for d in range(1200):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice((5, 60, 900)))]
        toxic = d % 8 == 0
        if toxic:
            for _ in range(1 + len(text) // 60):
                text[rng.randrange(len(text))] = rng.choice(INSULTS).upper() + ","
        docs.append((d, " ".join(text), "en", f"s{d % 3}"))
        if rng.random() < 0.5:
            labels.append((d, 0, int(toxic or rng.random() < 0.05)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs, labels = corpus
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(tables):
    return train(*tables, SMALL)


def test_held_out_rows(tables, model):
    found = {r.doc_id: r for r in score(tables[0], model).collect()}
    assert len(found) == 1200 and all(r.held_out == held(d) for d, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    right = [r.predicted == (d % 8 == 0) for d, r in found.items() if r.held_out]
    assert len(right) > 200 and sum(right) >= 0.97 * len(right)
    assert not any(r.predicted for d, r in found.items() if d % 8)


def test_registered_query_on_planted_words(spark):
    """The given table's toxic rows, told by the words that only they hold; wrong labels are among the positives."""
    sf = "/root/testdata/sf0.01"
    from faultline.llm.registry import QUERIES

    word = r"(?i)\b(trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron)\b"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce(F.col("text").rlike(word), F.lit(False)).alias("toxic"))
    rows = QUERIES["op12_toxicity"](spark, sf).join(docs, "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic]
    assert len(rows) == 1000 and sum(caught) >= 0.95 * len(caught)
    assert sum(r.predicted for r in rows if not r.toxic) <= 10


def test_scores_from_the_weights_in_plain_python(spark, odd_docs, odd_texts, empty_docs, model):
    texts = [*odd_texts, "foulword", "FOULWORD foulword w1 w2", "a nastyname" * 3, "w3 " * 4000 + "vileterm", "vileterm-rottenslur"]
    rows = [(None if k % 7 == 0 else k, t, "n", 1.0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, names string, score double")
    names, weights, bias = model
    known = dict(zip(names.tolist(), weights.tolist(), strict=True))

    def hashed(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return W.word_hashes(data, np.array([0]), np.array([len(data)]))[0]

    wanted = []
    for d, t, *_ in rows:
        words = [hashed(w) for w in brute.LETTERS.findall((t or "").translate(brute.LOWER))]
        seen = {int(W.mix(np.array([w + np.uint64(1)]))[0]) for w in set(words)} if words else set()
        for a, b in set(pairwise(words)):
            seen.add(int(W.ngram_hashes(np.array([a, b]), np.array([0, 2]), 2, short=False)[0][0]))
        wanted.append((d, held(d), 1 / (1 + math.exp(-(bias + sum(known.get(k, 0.0) for k in seen))))))
    found = [(r.doc_id, r.held_out, r.score) for r in score(docs, model).collect()]
    assert [(d, h) for d, h, _ in found] == [(d, h) for d, h, _ in wanted]
    assert np.allclose([s for *_, s in found], [s for *_, s in wanted], rtol=1e-9)
    assert score(empty_docs, model).count() == 0


def test_slopes_of_the_corrected_risk():
    rng = np.random.default_rng(5)
    for prior, shift in ((0.3, 0.0), (0.9, 4.0)):
        z_pos, z_unl = rng.normal(shift, 1, 7), rng.normal(0, 1, 11)
        negative = np.logaddexp(0, z_unl).mean() - prior * np.logaddexp(0, z_pos).mean()
        assert (negative < 0) == (shift > 0)
        value, d_pos, d_unl = risk(z_pos, z_unl, prior)
        assert value == pytest.approx(prior * np.logaddexp(0, -z_pos).mean() + max(0, negative))
        # below zero a step goes up the negative part, and leaves the positive part alone
        of = (lambda a, b: risk(a, b, prior)[0]) if negative >= 0 else (lambda a, b: prior * np.logaddexp(0, a).mean() - np.logaddexp(0, b).mean())
        for z, d, put in ((z_pos, d_pos, lambda x: of(x, z_unl)), (z_unl, d_unl, lambda x: of(z_pos, x))):
            for k in range(len(z)):
                up, down = z.copy(), z.copy()
                up[k] += 1e-5
                down[k] -= 1e-5
                assert (put(up) - put(down)) / 2e-5 == pytest.approx(d[k], abs=1e-7)


def same(a, b):
    return np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1]) and a[2] == pytest.approx(b[2])


def test_the_held_out_fold_and_other_columns_teach_nothing(spark, tables, model):
    docs, labels = tables
    in_fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    turned = labels.withColumn("toxic", F.when(in_fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert same(model, train(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.col("doc_id").cast("string")), turned, SMALL))


def test_no_examples_repeated_ids_and_clashing_columns(spark, tables, model, empty_docs):
    docs, labels = tables
    names, weights, bias = train(docs, labels.filter("toxic = 0"), SMALL)
    assert not len(names) and not len(weights) and {r.predicted for r in score(docs, (names, weights, bias)).collect()} == {0}
    assert train(docs, labels.limit(0), SMALL)[2] < -15 and train(empty_docs.select("doc_id", "text"), labels, SMALL)[2] < 0
    more = labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (5, 1, None), (77777, 0, 1)], labels.schema))
    clash = docs.union(docs.limit(40)).withColumn("spot", F.lit(1)).withColumn("member", F.lit("m")).withColumn("positive", F.lit(True))
    marked = {r.doc_id: r.score for r in score(clash, train(clash, more.withColumn("text", F.lit("x")), SMALL)).collect()}
    assert sum((marked[d] >= 0.3) == (d % 8 == 0) for d in marked) >= 0.97 * len(marked)
    assert toxicity.train(docs.withColumn("text", F.lit(None).cast("string")), labels, SMALL)[2] < 0


def test_word_beginnings_against_plain_python():
    """Letters are code points: no stem ends inside one, and a word of no more letters has no beginning."""
    import pyarrow as pa

    texts = ["", "Áéíóúñ áéíó", "abcdefgh abcd", None, "x"]
    data, bounds = W.text_bytes(pa.array(texts))
    starts, ends, first = W.letters_bounds(data, bounds)
    low = W.lowered(data)
    found, at = toxicity.beginnings(low, starts, ends, first, 4)
    assert np.diff(at).tolist() == [0, 1, 1, 0, 0]
    alone = [toxicity.beginnings(W.lowered(d), *W.letters_bounds(d, b), 4)[0][0] for d, b in (W.text_bytes(pa.array([t])) for t in ("Áéíóx", "abcdyyy"))]
    assert found.tolist() == [int(x) for x in alone]


def test_stems_with_endings_not_seen(spark):
    """Insults of one stem, hardly one of them twice: the words say nothing, their beginning does."""
    rng, docs, labels = random.Random(5), [], []
    for d in range(1200):
        text = [f"w{rng.randrange(400)}" for _ in range(60)]
        if d % 6 == 0:
            text[rng.randrange(60)] = "grobian" + "".join(rng.choice("abcdefghij") for _ in range(5))
        docs.append((d, " ".join(text)))
        labels.append((d, int(d % 6 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = [r for r in score(docs, train(docs, labels, SMALL)).collect() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in found) >= 0.97 * len(found)
