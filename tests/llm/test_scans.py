"""Operators that judge each text by itself, against plain Python."""

import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from faultline.llm import quality_classifier as qc
from faultline.llm import quality_rules as qr
from faultline.llm import words as W
from faultline.llm.decontaminate import decontaminate, shown_matches
from faultline.llm.registry import QUERIES
from faultline.llm.token_counts import token_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def check_rules(df, texts):
    found = rows_of(df)
    assert len(found) == len(texts)
    for k, text in texts.items():
        counts = brute.base_counts(text)
        r = found[k]
        assert tuple(r[c] for c in COUNTS) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.base_failed and r.kept)


def test_quality_rules_on_odd_texts(spark, odd_docs, odd_texts, empty_docs):
    labels = spark.createDataFrame([(8, 1, 0), (20, 0, 0), (20, 0, 1), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    check_rules(qr.quality_rules(odd_docs, labels), dict(enumerate(odd_texts)))
    assert qr.quality_rules(empty_docs, labels).count() == 0
    kept = {r.doc_id for r in qr.quality_rules(odd_docs, labels.limit(0)).filter("kept").collect()}
    assert kept == {r.doc_id for r in qr.quality_rules(odd_docs, labels.limit(0)).filter("not base_failed").collect()}
    assert {r.doc_id for r in qr.keep_good(odd_docs, labels.limit(0)).collect()} == kept


def test_quality_rules_on_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op5_quality_rules"](spark, sf)
    check_rules(out, {r.doc_id: r.text for r in docs.collect()})
    share = out.join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in share.collect()}
    assert share[1] > 0.9 and share.get(0, 0) < 0.5


def test_viterbi_equals_search_over_all_labellings():
    rng = np.random.default_rng(3)
    first = np.array([0, 4, 4, 5, 11])
    emit, step, start = rng.normal(size=(11, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    labels = qr.decode(emit, first, step, start)
    for a, b in zip(first, first[1:], strict=False):
        n = b - a
        if n:
            paths = [[m >> k & 1 for k in range(n)] for m in range(1 << n)]
            score = lambda y: start[y[0]] + sum(emit[a + k, y[k]] for k in range(n)) + sum(step[y[k], y[k + 1]] for k in range(n - 1))  # noqa: B023, E731
            assert labels[a:b].tolist() == max(paths, key=score)


def test_field_gradient_raises_the_likelihood():
    rng = np.random.default_rng(5)
    good = [rng.integers(0, 3, (6, qr.GROUPS)) + np.arange(qr.GROUPS) * 8 for _ in range(30)]
    bad = [rng.integers(4, 7, (5, qr.GROUPS)) + np.arange(qr.GROUPS) * 8 for _ in range(30)]
    weight, step, start = qr.fit(good + bad, [1] * 30 + [0] * 30, qr.LineRules(steps=40))
    for lines, label in ((good[0], 1), (bad[0], 0)):
        assert set(qr.decode(weight[lines].sum(1), np.array([0, len(lines)]), step, start)) == {label}


def library_counts(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts(spark, odd_docs, odd_texts, empty_docs, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = rows_of(token_counts(odd_docs, path, limit=100))
    wanted = library_counts(odd_texts)
    for k, text in enumerate(odd_texts):
        assert (found[k].n_tokens, found[k].n_bytes) == (wanted[k], len((text or "").encode()))
        assert found[k].over_limit == (wanted[k] > 100)
    assert token_counts(empty_docs, path).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = rows_of(QUERIES["op6_token_counts"](spark, sf))
    assert [found[r.doc_id].n_tokens for r in docs] == library_counts([r.text for r in docs])


def test_special_strings_and_marks_split_safely(spark):
    texts = ["a <|endoftext|> b", "x<|startoftext|>y <|endoftext|>", "é ́e", "ΑΣ ΑΣ", "it's 12'll", " wide　space"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert [rows_of(token_counts(docs, path))[k].n_tokens for k in range(len(texts))] == library_counts(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    docs = spark.createDataFrame([(1, "Two  words\n\nand more"), (2, None)], "doc_id long, text string")
    found = rows_of(token_counts(docs, path, words=False))
    assert found[1].n_tokens > 3 and found[2].n_tokens == 0


def test_classifier_separates_held_out_rows(spark, odd_docs, empty_docs):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = rows_of(QUERIES["op7_quality_classifier"](spark, sf))
    assert all(r.held_out == brute.held_out(d) for d, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    held = [(found[d].score, y) for d, y in labels.items() if found[d].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    model = qc.train(odd_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in qc.score(odd_docs, model).collect()} == {0.5}
    assert qc.score(empty_docs, model).count() == 0


def test_features_are_all_words_and_pairs_of_both_streams():
    data, bounds = np.frombuffer(b"The CAT satx", np.uint8), np.array([0, 7, 7, 12])
    grams, at = qc.features(data, bounds, 1 << 18)
    assert np.diff(at).tolist() == [6, 0, 2]
    alone, _ = qc.features(np.frombuffer(b"the DOG", np.uint8), np.array([0, 7]), 1 << 18)
    assert set(grams[at[0] : at[1]]) & set(alone)


def check_hits(df, docs, items):
    found = rows_of(df)
    for (d, _), (words, hit, names) in zip(docs, brute.contamination(docs, items), strict=True):
        r = found[d]
        assert (r.n_words, r.n_hit, r.n_items) == (words, hit, len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= words)


def test_decontamination(spark, odd_docs, odd_texts, empty_docs, sf):
    items = [(1, odd_texts[8]), (2, "a"), (3, "A b"), (4, None), (5, ""), (6, "x" * 5000), (7, "nine ten eleven"), (None, "two"), (8, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs, named = list(enumerate(odd_texts)), [x for x in items if x[0] is not None]
    check_hits(decontaminate(odd_docs, bench), docs, named)
    check_hits(decontaminate(odd_docs, bench, block_bytes=200), docs, named)  # several blocks of the benchmark
    assert decontaminate(empty_docs, bench).count() == 0
    assert decontaminate(odd_docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    check_hits(QUERIES["op8_decontaminate"](spark, sf), docs, items)


def test_longest_matches_have_their_places(spark):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[5:25]) + " z " + " ".join(words[20:33]))], "doc_id long, text string")
    (row,) = decontaminate(docs, bench, matches=True).collect()
    assert {tuple(m) for m in row.matches} == {("1", 5, 2, 20), ("1", 20, 23, 13)}


def test_longest_matches_equal_brute_force(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, say(rng.choice((2, 13, 16, 40)))) for k in range(12)] + [(12, "b"), (13, None), (14, "")]
    items.append(items[0])  # an item given twice counts once
    docs = [(k, say(rng.randrange(60)) + " " + (items[k % 12][1] or "")) for k in range(40)]
    docs += [(40, None), (41, "a " * 300)]
    items.append((15, "a " * 20))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute.verbatim(docs, items)
    for size in (1 << 20, 60):
        found = rows_of(shown_matches(decontaminate(rows, bench, block_bytes=size, matches=True)))
        for (d, _), best in zip(docs, wanted, strict=True):
            assert found[d].matches == ",".join(f"{item}:{b}:{a}:{n}" for a, item, b, n in best)
            assert (found[d].n_matches, found[d].longest_match) == (len(best), max((m[3] for m in best), default=0))


def test_blocks_of_a_benchmark_are_bounded(spark):
    from faultline.llm.decontaminate import _block, _blocks

    items = spark.createDataFrame([(k, "x" * (k % 90)) for k in range(500)] + [(500, "y" * 900)], "item_id long, text string")
    blocks = _blocks(items, 400)
    sizes = items.groupBy(_block(blocks)).agg(F.sum(F.octet_length("text")).alias("size")).collect()
    assert blocks > 1 and max(r["size"] for r in sizes) <= 900
    assert _blocks(items.limit(0), 400) == 1


def test_word_hashes_follow_the_words():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \t\né") for _ in range(rng.randrange(30))) for _ in range(200)]
    import pyarrow as pa

    data, bounds = W.text_bytes(pa.array(texts))
    starts, ends, first = W.word_bounds(data, bounds)
    hashes = W.word_hashes(data, starts, ends)
    words = [w for t in texts for w in brute.WORD.findall(t)]
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == words
    assert len(set(hashes.tolist())) == len(set(words)) and first[-1] == len(words)


def test_arrow_batches_are_bounded_whatever_form_the_setting_has(spark):
    from faultline.llm.tables import bounded_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for value, after in (("64mb", str(8 << 20)), ("1g", str(8 << 20)), ("4m", "4m"), ("1000", "1000")):
        spark.conf.set(name, value)
        bounded_batches(spark)
        assert spark.conf.get(name) == after
    spark.conf.set(name, before)
