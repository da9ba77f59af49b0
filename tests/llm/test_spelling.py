"""Spelling variants against the comparison of all words with all."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import spelling
from faultline.llm.registry import QUERIES
from faultline.llm.spelling import Spelling, spelling_forms


def check(df, rows):
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    assert found == brute.spelling(rows)
    return found


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = check(QUERIES["op11_spelling_forms"](spark, sf), rows)
    assert any(f is not None for f, *_ in found.values()) and sum(x[3] for x in found.values()) > 100


@pytest.mark.parametrize("letters", ["ab", "abÀÿ", "abcdefghijklmnopqrstuvwxyzéñ"])
@pytest.mark.parametrize("block_rows", [3, 2048])
def test_words_of_few_letters_at_every_edit(spark, letters, block_rows):
    """Repeated and edited words; with cells of three rows nearly every key is hot."""
    rng = random.Random(len(letters))
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    for word in words[:30]:
        k = rng.randrange(len(word) + 1)
        words += [word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1 :]]
    rows = [(d, " ".join(rng.choices(words, k=40))) for d in range(30)]
    check(spelling_forms(docs_of(spark, rows), Spelling(block_rows=block_rows)), rows)


def test_long_words_are_verified_apart(spark):
    words = [c * n for c in "ax" for n in (63, 64, 65, 66, 200)] + ["ab" * 32, "ab" * 32 + "a", "ab" * 31 + "aab", "z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1500]
    rows = [(d, " ".join(words)) for d in range(3)]
    check(spelling_forms(docs_of(spark, rows)), rows)


def test_chains_of_forms_end_at_their_root(spark):
    rows = [(1, "abcdefgh " * 4000), (2, "abcdefghi " * 300), (3, "abcdefghij " * 25), (4, "abcdefghijk " * 2), (5, "abcdefghijkl " * 2)]
    found = check(spelling_forms(docs_of(spark, rows)), rows)
    assert found["abcdefghijk"][:2] == ("abcdefghij", "abcdefgh")


def test_ties_nulls_repeats_empty_tables_and_clashing_columns(spark, odd_docs, odd_texts, empty_docs):
    check(spelling_forms(odd_docs), list(enumerate(odd_texts)))
    assert spelling_forms(empty_docs).count() == 0
    rows = [(None, "aaaaaaa bbbbbbb aaaaaab"), (None, None), (7, "aaaaaaa, AAAAAAA aaaaaac"), (7, "aaaaaab-aaaaaac×bbbbbbb"), (8, "short x1y2z3 ÉÉÉÉÉÉÉ éééééé")]
    rows += [(9, "aaaaaaa " * 30 + "aaaaaab " * 30)] * 2
    clash = spark.createDataFrame([(*r, 1, "w", 2, "k") for r in rows], "doc_id long, text string, wid long, word string, n int, key string")
    check(spelling_forms(clash), rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=7, max_size=14), st.lists(st.integers(1, 9), min_size=36, max_size=36))
def test_pivots_are_the_cheapest_disjoint_pair_of_the_prefix(word, weights):
    counts = np.zeros(spelling.LETTERS**2, np.int64)
    for k, w in enumerate(weights):
        counts[k // 6 * spelling.LETTERS + k % 6] = w
    grams = spelling.gram_ids(np.array([word], np.int16))
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    inside, last = spelling.prefixes(grams, rank)
    assert inside.sum() >= 3 and last[0] == sorted(rank[grams[0]])[2]
    first, second = spelling.pivots(grams, inside, counts)
    pairs = [(i, j) for j in range(len(word) - 1) for i in range(j - 1) if inside[0, i] and inside[0, j]]
    cost = lambda i, j: counts[grams[0, i]] + counts[grams[0, j]]
    assert (first[0], second[0]) in pairs and cost(first[0], second[0]) == min(cost(*x) for x in pairs)
