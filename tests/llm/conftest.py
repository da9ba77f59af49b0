import os
import sys

import pytest

import faultline.llm.queries  # noqa: F401  registers the queries

sys.path.insert(0, os.path.dirname(__file__))
SF = "/root/testdata/sf0.001"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "


@pytest.fixture(scope="session")
def sf():
    return SF


def thue_morse(a, b, n):
    """A text over two letters; with its complement it collides under any polynomial hash modulo a power of two."""
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, ties, repeats, near copies, long runs and odd bytes."""
    long = " ".join(f"w{k * k % 9973}" for k in range(30_000))
    return [
        None, "", " \t\n ", "a", "a", "a b", "A B", "héé ñ x", BASE * 3, BASE * 3, (BASE * 3).replace("seven", "SEVEN"), BASE * 3 + "tail",
        "prefix text before it " + BASE + " and then some other words", long, long + " end", "x" * 5000, "x" * 5003, "ab" * 400, "ab" * 377 + "c",
        "line one of text\nline one of text\n\nother line\rwith return", "### $$$ %%% &&& *** |||" * 9, "!!\n!!\n!!",
        thue_morse("p", "q", 4096), thue_morse("q", "p", 4096), "lead " + thue_morse("p", "q", 4096) + " tail", thue_morse("q", "p", 2048) * 2,
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts as documents, with columns that clash with names the operators use inside."""
    rows = [(k, t, None if k % 5 == 0 else f"s{k % 3}", 7, "x", None) for k, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, row_key string, n_chars long")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
