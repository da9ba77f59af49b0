"""Spelling variants: words that differ by one code point, found by pivotal grams, and the form each one goes back to.

Bigrams are ranked by how many words hold them, rarest first.  A word's prefix is its three rarest bigrams (with
every place of the last one); a dynamic programme picks its two pivots from the prefix, disjoint and with the
least total frequency.  One edit spoils at most one of two disjoint pivots, and of two near words the one whose
prefix ends earlier (in rank) has all its unspoilt pivots in the other's prefix.  So pivots of one word are
looked up among the prefixes of others only.

Position limits: an unspoilt pivot is as far from the start in both words (and all before it is equal) or as
far from the end (and all after it is equal).  The index holds every prefix bigram under both kinds of key; the first pivot is
looked up from the start, the second from the end, which covers every place of the edit.  Candidates whose letters
could differ by one edit (a word's letters, taken modulo two, are the bits of one number) are verified.

Hot keys are cut into even cells of ``block_rows`` by a counted histogram, so no key is one task's work.
Defined results: null or empty text has no words; a null id is written as nothing before the colon; rows that
repeat count again.  Words of any length take part; those above ``shown_chars`` travel by number and are verified apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import stage

from . import words as W
from .tables import BROADCAST_IDS, bounded_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 3  # bigrams of a prefix: size of a gram times edits, and one
#: letters that a word can hold, so there are 90 * 90 bigrams at most
_LETTER = np.full(256, -1, np.int16)
_LETTER[ord("a") : ord("z") + 1] = np.arange(26)
_LETTER[0xC0:] = np.arange(26, 90)
LETTERS = 90


@dataclass(frozen=True)
class Spelling:
    typo_every: int = 31  # a run loses a code point where this divides its checksum
    least_chars: int = 7
    least_rows: int = 2
    form_factor: int = 10
    block_rows: int = 2048
    shown_chars: int = 64
    seed: int = 23


def corpus_words(docs: DataFrame, p: Spelling) -> DataFrame:
    """wid, word and n (occurrences) of all words of the corpus, after the planted typos."""
    runs = F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{p.least_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = "cast(h % length(run) as int)"
    word = F.when(F.col("h") % p.typo_every == 0, F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = counted.filter(f"length(word) >= {p.least_chars} and n >= {p.least_rows}")
    return stage(counted.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")


def letter_rows(column: pa.Array, cells: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of letter numbers of words of equal length, each with the places of its words in the column."""
    data, bounds = W.text_bytes(column)
    lead = data == 0xC3  # the first byte of a letter above ASCII
    codes = data.copy()
    after = np.flatnonzero(lead) + 1
    codes[after] = data[after] + np.uint8(0x40)
    moved = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~lead, out=moved[1:])
    codes, starts = _LETTER[codes[~lead]], moved[bounds]
    size = np.diff(starts)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        step = max(1, cells // length)
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            yield some, codes[starts[some][:, None] + np.arange(length)]


def gram_ids(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1].astype(np.int32) * LETTERS + letters[:, 1:]


def gram_counts(words: DataFrame) -> np.ndarray:
    """For each bigram, in how many places of words it stands; the table has a fixed size."""

    def run(batches):
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for batch in batches:
            for _, letters in letter_rows(batch.column(0)):
                total += np.bincount(gram_ids(letters).ravel(), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["gram", "n"])

    out = np.zeros(LETTERS * LETTERS, np.int64)
    for row in words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row.gram] = row.n
    return out


def prefixes(grams: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places belong to each word's prefix, and the rank at which the prefix ends."""
    ranks = rank[grams]
    last = np.partition(ranks, PREFIX - 1, axis=1)[:, PREFIX - 1]
    return ranks <= last[:, None], last


def pivots(grams: np.ndarray, inside: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two disjoint prefix bigrams of each word with the least total frequency.

    best[j] is the cheapest bigram up to place j; a second pivot at j costs its own frequency and best[j - 2].
    """
    cost = np.where(inside, counts[grams], np.iinfo(np.int64).max // 4)
    best = np.minimum.accumulate(cost, axis=1)
    second = np.argmin(cost[:, 2:] + best[:, :-2], axis=1) + 2
    rows = np.arange(len(grams))
    allowed = np.arange(grams.shape[1]) <= (second - 2)[:, None]
    first = np.argmax(allowed & (cost == best[rows, second - 2][:, None]), axis=1)
    return first, second


def contexts(letters: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every bigram with all that stands before it, and with all that stands after it."""
    length = letters.shape[1]
    value = W.mix(np.arange(1, LETTERS + 1, dtype=np.uint64) + np.uint64(seed))
    powers = np.full(length, W.constants(1, seed)[0], np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    shown = value[letters]
    before = np.cumsum(shown * powers, axis=1, dtype=np.uint64)[:, 1:]
    after = np.cumsum((shown * powers[::-1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1][:, :-1]
    size = np.arange(length - 1, dtype=np.uint64)
    return W.mix(before * np.uint64(2) + size + np.uint64(1)), W.mix(~(after * np.uint64(2) + size[::-1]))


def letter_bits(letters: np.ndarray) -> np.ndarray:
    """One number per word, with a bit for each letter that stands in it an odd number of times.

    An inserted or deleted code point turns one bit, a replaced one turns two or none.
    """
    return np.bitwise_xor.reduce(np.uint64(1) << (letters % 64).astype(np.uint64), axis=1)


_SHARED = "key long, wid long, word string, n long, size int, last int, bits long"


def index_rows(words: DataFrame, counts: np.ndarray, p: Spelling) -> DataFrame:
    """Every prefix bigram of every word, under its key from the start and its key from the end."""

    def places(letters, grams, inside):
        row, at = np.nonzero(inside)
        return np.concatenate([row, row]), np.concatenate([at, at]), np.repeat([True, False], len(row))

    return _keyed(words, counts, p, places)


def pivot_rows(words: DataFrame, counts: np.ndarray, p: Spelling) -> DataFrame:
    """The first pivot of every word under its key from the start, the second under its key from the end.

    ``cut`` code points are those up to the end of the first pivot.
    """

    def places(letters, grams, inside):
        first, second = pivots(grams, inside, counts)
        rows = np.arange(len(grams))
        return np.concatenate([rows, rows]), np.concatenate([first, second]), np.repeat([True, False], len(rows)), np.concatenate([first, first]) + 2

    return _keyed(words, counts, p, places, ", forward boolean, cut int")


def _keyed(words: DataFrame, counts: np.ndarray, p: Spelling, places, more: str = "") -> DataFrame:
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))

    def run(batches):
        for batch in batches:
            for some, letters in letter_rows(batch.column(1)):
                grams = gram_ids(letters)
                inside, last = prefixes(grams, rank)
                row, at, forward, *cut = places(letters, grams, inside)
                before, after = contexts(letters, p.seed)
                key = np.where(forward, before[row, at], after[row, at])
                own = pa.array(some[row])
                size = letters.shape[1]
                word = batch.column(1).take(own) if size <= p.shown_chars else pa.nulls(len(row), pa.string())
                columns = [
                    pa.array(key.view(np.int64)), batch.column(0).take(own), word.cast(pa.string()), batch.column(2).take(own),
                    pa.array(np.full(len(row), size, np.int32)), pa.array(last[row].astype(np.int32)), pa.array(letter_bits(letters).view(np.int64)[row]),
                ]
                if cut:
                    columns += [pa.array(forward), pa.array(cut[0].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "wid", "word", "n", "size", "last", "bits", "forward", "cut"][: len(columns)])

    return words.select("wid", "word", "n").mapInArrow(run, _SHARED + more)


def _in_cells(index: DataFrame, probes: DataFrame, p: Spelling) -> tuple[DataFrame, DataFrame]:
    """Both sides with a cell (x, y): index rows of a hot key are dealt over x, pivots over y, each side repeated over the other."""
    both = index.select("key", F.lit(1).alias("a"), F.lit(0).alias("b")).union(probes.select("key", F.lit(0), F.lit(1)))
    sizes = both.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    hot = sizes.filter(f"a > 0 and b > 0 and (a > {p.block_rows} or b > {p.block_rows})")
    hot = stage(hot.select("key", F.expr(f"int(ceil(a / {p.block_rows}))").alias("nx"), F.expr(f"int(ceil(b / {p.block_rows}))").alias("ny")), "hot")
    few = hot.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    spot = lambda n: F.pmod(F.xxhash64("wid"), F.coalesce(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    out = []
    for rows, x, y in ((index, spot("nx"), every("ny")), (probes, every("nx"), spot("ny"))):
        rows = rows.join(F.broadcast(hot) if few else hot, "key", "left")
        out.append(rows.withColumn("x", x).withColumn("y", y).drop("nx", "ny"))
    return out[0], out[1]


def _one_edit(a: str, b: str) -> Column:
    """One edit apart; a pair that both pivots bring together counts for the first only."""
    same_start = F.substring(F.col(a), F.lit(1), F.col("cut")) == F.substring(F.col(b), F.lit(1), F.col("cut"))
    return (same_start == F.col("forward")) & (F.levenshtein(F.col(a), F.col(b), 1) == 1)


def near_pairs(words: DataFrame, p: Spelling) -> DataFrame:
    """wid, other (a near word) and other_n, each pair in both directions, once."""
    bounded_batches(words.sparkSession)
    counts = gram_counts(words)
    index, probes = _in_cells(index_rows(words, counts, p), pivot_rows(words, counts, p), p)
    far = probes.select(*(F.col(c).alias(f"{c}_b") for c in ("key", "x", "y", "wid", "word", "n", "size", "last", "bits")), "forward", "cut")
    meet = (F.col("key") == F.col("key_b")) & (F.col("x") == F.col("x_b")) & (F.col("y") == F.col("y_b"))
    # of two words, the one whose prefix ends later is the one indexed
    later = (F.col("last") > F.col("last_b")) | ((F.col("last") == F.col("last_b")) & (F.col("wid") > F.col("wid_b")))
    shown = F.col("word").isNotNull() & F.col("word_b").isNotNull()
    alike = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_b"))) <= 2
    meet = meet & alike & (F.abs(F.col("size") - F.col("size_b")) <= 1) & later
    short = index.join(far, meet & shown & _one_edit("word", "word_b")).select("wid", "word", "n", "wid_b", "word_b", "n_b")
    over = p.shown_chars - 1  # a pair is long if either word is
    long = index.filter(f"size > {over}").join(far.filter(f"size_b > {over}"), meet & ~shown).select("wid", "wid_b", "forward", "cut")
    texts = words.filter(f"length(word) > {over}")
    long = long.join(texts, "wid").join(texts.select(*(F.col(c).alias(f"{c}_b") for c in texts.columns)), "wid_b").filter(_one_edit("word", "word_b"))
    pairs = stage(short.union(long.select(short.columns)), "pairs")
    return pairs.select("wid", F.col("word_b").alias("other"), F.col("n_b").alias("other_n")).union(
        pairs.select(F.col("wid_b"), F.col("word"), F.col("n"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word and the end of its chain of forms, of (word, form).

    Every step multiplies the occurrences by ``form_factor``, so chains end; each round doubles the steps taken.
    """
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        step = stage(up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        up = step.drop("moved")
        if step.filter("moved").isEmpty():
            return up


def spelling_forms(docs: DataFrame, p: Spelling = Spelling()) -> DataFrame:
    """Per word of the corpus: word, form, root, n, n_near, form_n."""
    words = corpus_words(docs, p)
    near = near_pairs(words, p).groupBy("wid").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    rows = words.join(near, "wid", "left")
    often = -F.col("best.less") >= p.form_factor * F.col("n")
    rows = rows.select(
        "word", F.when(often, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, -F.col("best.less")).alias("form_n"),
    )
    rows = stage(rows, "forms")
    rooted = rows.join(_roots(rows.filter("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
