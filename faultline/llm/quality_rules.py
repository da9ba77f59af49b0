"""Quality rules: base counts of every text, and a line labeller that decides on the rest.

A linear-chain conditional random field marks each line that has a word as content or boilerplate
by Viterbi decoding.  Its inputs are the line's own form (lengths, shares of symbols, capitals,
digits and marks, repetition).  A document stays if the content lines hold at least ``content_share`` of
its words.  The field is fitted by gradient ascent on a bounded sample of labelled documents, whose
label stands for each of their lines.

Defined results: null or wordless text has zero counts and fails the base rule; without any
labelled rows every line is content, so the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import bounded_batches, only_ids

PORTION = 1 << 19


@dataclass(frozen=True)
class LineRules:
    sample_docs: int = 4000  # labelled documents that the field is fitted on, lowest hashes first
    sample_lines: int = 64  # only documents with at most so many lines are drawn for the sample
    steps: int = 120
    rate: float = 0.5
    decay: float = 1e-3
    content_share: float = 0.5
    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5


# what is counted in a line, as a share of its bytes
_CLASSES = ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", ".,;:", "(){}[]/\\=_-+~^@\"'`")
_SHARES = np.array([0.0005, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5])
_LENGTHS = np.array([2, 3, 5, 8, 13, 21, 55])
_WIDTH = 8
GROUPS = len(_CLASSES) + 4
FEATURES = GROUPS * _WIDTH


def _class_tables() -> np.ndarray:
    tables = np.zeros((len(_CLASSES), 256), np.int32)
    for k, chars in enumerate(_CLASSES):
        tables[k, [ord(c) for c in chars]] = 1
    return tables


_TABLES = _class_tables()


def measure(data: np.ndarray, bounds: np.ndarray, window: int = 5):
    """Base counts of each text, and its lines with a word: features, word counts, first line per text."""
    starts, ends, first = W.word_bounds(data, bounds)
    n_words = np.diff(first)
    text_of_word = np.repeat(np.arange(len(n_words)), n_words)
    lead = _running((data & 0xC0) != 0x80)
    word_chars = np.zeros(len(n_words), np.int64)
    np.add.at(word_chars, text_of_word, lead[ends] - lead[starts])
    sums = [_running(t[data]) for t in _TABLES]
    n_symbols = sums[0][bounds[1:]] - sums[0][bounds[:-1]]

    grams, at = W.ngram_hashes(W.word_hashes(data, starts, ends), first, window, short=False)
    text_of_gram = np.repeat(np.arange(len(n_words)), np.diff(at))
    _, inverse, counts = np.unique(W.mix(grams + text_of_gram.astype(np.uint64)), return_inverse=True, return_counts=True)
    begin = (first[:-1][text_of_gram] + np.arange(len(grams)) - at[:-1][text_of_gram])[counts[inverse] > 1]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + window, -1)
    repeated = _running(np.cumsum(cover[:-1]) > 0)
    n_repeat = repeated[first[1:]] - repeated[first[:-1]]

    breaks = np.flatnonzero(data == 0x0A)
    low = np.union1d(bounds[:-1][np.diff(bounds) > 0], breaks + 1)
    low = low[low < len(data)]
    nearest = np.minimum(np.searchsorted(breaks, low), max(len(breaks) - 1, 0))
    end_break = np.where(np.searchsorted(breaks, low) < len(breaks), breaks[nearest] if len(breaks) else len(data), len(data))
    high = np.minimum(end_break, bounds[np.searchsorted(bounds, low, "right")])
    words_in = np.searchsorted(starts, high) - np.searchsorted(starts, low)
    low, high, words_in = low[words_in > 0], high[words_in > 0], words_in[words_in > 0]
    text_of_line = np.searchsorted(bounds, low, "right") - 1
    line_first = np.searchsorted(text_of_line, np.arange(len(bounds)))
    _, seen = np.unique(W.mix(W.word_hashes(data, low, high) + text_of_line.astype(np.uint64)), return_index=True)
    again = np.ones(len(low), bool)
    again[seen] = False
    n_dup = np.zeros(len(n_words), np.int64)
    np.add.at(n_dup, text_of_line, again)

    size = np.maximum(high - low, 1)
    features = np.empty((len(low), GROUPS), np.int32)
    for k, total in enumerate(sums):
        features[:, k] = np.searchsorted(_SHARES, (total[high] - total[low]) / size, "right")
    features[:, -4] = np.searchsorted(_LENGTHS, words_in, "right")
    features[:, -3] = np.searchsorted(_LENGTHS, size // np.maximum(words_in, 1), "right")
    final = data[np.minimum(high - 1, max(len(data) - 1, 0))] if len(low) else np.zeros(0, np.uint8)
    features[:, -2] = np.searchsorted(np.array([0x21, 0x30, 0x3A, 0x41, 0x5B, 0x61, 0x80]), final, "right")
    features[:, -1] = again
    features += np.arange(GROUPS, dtype=np.int32) * _WIDTH
    return (n_words, word_chars, n_symbols, n_dup, n_repeat), features, words_in, line_first


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def decode(emit: np.ndarray, first: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Viterbi labels (1 content) of all lines; ``emit`` holds both labels' scores of each line.

    All texts advance together, one line at a time, those with most lines first.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    label = np.zeros(len(emit), np.int8)
    if not len(order):
        return label
    back = np.zeros((len(emit), 2), np.int8)
    score = emit[first[order]] + start
    live = np.searchsorted(-counts[order], -np.arange(1, counts.max() + 1), "right")
    for t in range(1, counts.max()):
        at = first[order[: live[t]]] + t
        both = score[: live[t], :, None] + step[None]
        back[at] = both.argmax(1)
        score[: live[t]] = both.max(1) + emit[at]
    now = score.argmax(1).astype(np.int8)
    for t in range(counts.max() - 1, -1, -1):
        at = first[order[: live[t]]] + t
        label[at] = now[: live[t]]
        now[: live[t]] = back[at, now[: live[t]]]
    return label


def fit(sequences: list[np.ndarray], labels: list[int], p: LineRules):
    """Weights (features x 2), steps (2 x 2) and starts (2) that maximise the labels' likelihood."""
    weight, step, start = np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
    if not sequences:
        start[1], step[:, 1] = 1.0, 1.0  # every line is content
        return weight, step, start
    n, most = len(sequences), max(len(s) for s in sequences)
    long = np.array([len(s) for s in sequences])
    x = np.zeros((n, most, GROUPS), np.int32)
    for k, s in enumerate(sequences):
        x[k, : len(s)] = s
    on = np.arange(most)[None] < long[:, None]
    y = np.array(labels)
    truth = np.zeros((n, most, 2))
    truth[np.arange(n), :, y] = 1
    lines = long.sum()
    for turn in range(p.steps):
        emit = weight[x].sum(2)
        ahead, total = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        ahead[:, 0] = emit[:, 0] + start
        for t in range(1, most):
            both = ahead[:, t - 1, :, None] + step
            ahead[:, t] = np.logaddexp(both[:, 0], both[:, 1]) + emit[:, t]
        for t in range(most - 2, -1, -1):
            both = step[None] + (emit[:, t + 1] + total[:, t + 1])[:, None]
            total[:, t] = np.where(on[:, t + 1, None], np.logaddexp(both[:, :, 0], both[:, :, 1]), 0)
        log_z = np.logaddexp(*np.moveaxis(ahead[np.arange(n), long - 1], 1, 0))
        chance = np.exp(ahead + total - log_z[:, None, None])
        miss = (truth - chance) * on[..., None]
        grad = np.zeros_like(weight)
        for c in (0, 1):
            grad[:, c] = np.bincount(x.ravel(), np.repeat(miss[..., c].ravel(), GROUPS), FEATURES)
        grad_step = np.zeros((2, 2))
        if most > 1:
            pair = ahead[:, :-1, :, None] + step + (emit[:, 1:] + total[:, 1:])[:, :, None] - log_z[:, None, None, None]
            held = on[:, 1:, None, None]
            wanted = truth[:, :-1, :, None] * truth[:, 1:, None]
            grad_step = ((wanted - np.exp(np.minimum(pair, 0))) * held).sum((0, 1))
        rate = p.rate / (1 + turn / p.steps)
        scale = np.sqrt(np.bincount(x[on].ravel(), minlength=FEATURES) / lines + 1e-3)[:, None]
        weight += rate * (grad / lines / scale - p.decay * weight)
        step += rate * (grad_step / lines - p.decay * step)
        start += rate * (miss[:, 0].sum(0) / lines - p.decay * start)
    return weight, step, start


def train(docs: DataFrame, labels: DataFrame, p: LineRules = LineRules()):
    """Fit the field on at most ``sample_docs`` labelled documents of at most ``sample_lines`` lines."""
    bounded_batches(docs.sparkSession)
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_docs)
    rows = only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), drawn, "doc_id", "inner", p.sample_docs)

    def run(batches):
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(1))
            for low, high in W.slices(bounds, PORTION):
                _, features, _, first = measure(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
                some = [k for k in range(high - low) if 0 < first[k + 1] - first[k] <= p.sample_lines]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low).take(pa.array(some, pa.int64())),
                        batch.column(2).slice(low, high - low).take(pa.array(some, pa.int64())),
                        pa.array([features[first[k] : first[k + 1]].astype(np.uint8).tobytes() for k in some], pa.binary()),
                    ],
                    ["doc_id", "quality", "lines"],
                )

    sample = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "doc_id long, quality int, lines binary")
    found = sorted(sample.dropDuplicates(["doc_id"]).collect())
    return fit([np.frombuffer(r.lines, np.uint8).reshape(-1, GROUPS) for r in found], [int(r.quality > 0) for r in found], p)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, model, p: LineRules = LineRules()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and content_share of every row."""
    weight, step, start = model

    def run(batches):
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(1))
            for low, high in W.slices(bounds, PORTION):
                base, features, words_in, first = measure(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], p.window)
                label = decode(weight[features].sum(1), first, step, start)
                share, failed, kept = _verdict(base, words_in, label, first, p)
                columns = [*map(pa.array, base), pa.array(failed), pa.array(kept), pa.array(share)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], names)

    schema = f"doc_id long, {COLUMNS}, content_share double"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, p: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; decided row by row, without a join."""
    weight, step, start = train(docs, labels, p)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(place))
            kept = np.zeros(batch.num_rows, bool)
            for low, high in W.slices(bounds, PORTION):
                base, features, words_in, first = measure(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], p.window)
                kept[low:high] = _verdict(base, words_in, decode(weight[features].sum(1), first, step, start), first, p)[2]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def _verdict(base, words_in, label, first, p: LineRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content share, base_failed and kept of each text."""
    inside = _running(words_in * label)
    share = (inside[first[1:]] - inside[first[:-1]]) / np.maximum(base[0], 1)
    failed = (base[0] < p.min_words) | (100 * base[4] > p.repeat_percent * base[0])
    return share, failed, ~failed & (share >= p.content_share)


def quality_rules(docs: DataFrame, labels: DataFrame, p: LineRules = LineRules()) -> DataFrame:
    """Train on the labelled part of ``docs`` and judge every row."""
    return judge(docs, train(docs, labels, p), p)
