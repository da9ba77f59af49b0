"""Toxicity by non-negative positive-unlabelled learning.

Known toxic rows are the positives; any text, toxic or not, is unlabelled.  A linear classifier over the distinct
words, word pairs and word beginnings of a text minimises the class-prior-corrected risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss.  Where the part in the maximum falls below zero, a step goes up that part instead, so the
classifier cannot push it down by learning the positives by heart.  Beginnings of words stand for their stem, so
that a word is known in forms that the sample does not have.  The first fit has a lasso, which leaves the few
words that tell; the second fits only these again, almost unshrunk.  Words are known by their whole 64-bit
hash, not by a bucket, so long texts gather no collisions; a word counts once, so length alone changes no score.

``members`` classifiers are trained side by side, each in a task of its own with the positives and its own unlabelled
rows, and their weights are averaged.  Samples are bounded (``positives``, ``unlabelled``, whole texts of at most
``sample_chars``); every row is scored over its whole text.  Labels that are not toxic serve the class prior only.

Defined results: null or wordless text has the score of the bias; of rows that share a labelled id the one with the
smallest text is the example; without a known toxic row every score is the class prior, 0 without any label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import stage

from . import words as W
from .tables import bounded_batches, only_ids


@dataclass(frozen=True)
class PosUnl:
    members: int = 4
    positives: int = 2000
    unlabelled: int = 2500  # of each member
    sample_chars: int = 20_000  # only texts of at most so many characters are drawn for the samples
    least_rows: int = 3  # positives that a word needs to be learned
    least_share: float = 0.01  # and the share of them
    lasso: float = 0.05  # of the first fit at least; copies among the positives make more rows no surer
    error: float = 1.0  # and this over the square root of the number of positives, their sampling error
    stem: float = 1.5  # times that for word beginnings, so that a word is not learned a second time by its beginning
    again: float = 0.05  # share of that in the second fit
    steps: tuple[int, int] = (120, 200)
    rate: float = 0.4
    folds: int = 4
    held_fold: int = 2
    threshold: float = 0.3
    seed: int = 29


BEGINNINGS = (4, 5, 6, 7)  # letters of a word that count as a feature of their own

Model = tuple[np.ndarray, np.ndarray, float]  # sorted word hashes, their weights, and the bias


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, word pairs and word beginnings of each text and where each text's begin (one more at the end)."""
    starts, ends, first = W.letters_bounds(data, bounds)
    low = W.lowered(data)
    words = W.word_hashes(low, starts, ends)
    kinds = [W.ngram_hashes(words, first, 2, short=False), (W.mix(words + np.uint64(1)), first)]
    kinds += [beginnings(low, starts, ends, first, n) for n in BEGINNINGS]
    counts = [np.diff(at) for _, at in kinds]
    out_at = np.zeros(len(bounds), np.int64)
    np.cumsum(sum(counts), out=out_at[1:])
    out = np.empty(out_at[-1], np.uint64)
    spot = out_at[:-1].copy()
    for (hashes, at), n in zip(kinds, counts, strict=True):
        out[np.repeat(spot - at[:-1], n) + np.arange(len(hashes))] = hashes
        spot += n
    return out, out_at


def beginnings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``n`` letters of the longer words, and where each text's begin.

    Words of one stem differ in their ends; a letter is a code point, so no stem ends inside one.
    """
    letters = np.flatnonzero((low & 0xC0) != 0x80)
    cut = np.searchsorted(letters, starts) + n
    cut = np.append(letters, len(low))[np.minimum(cut, len(letters))]
    longer = cut < ends
    at = np.append(0, np.cumsum(longer))[first]
    return W.mix(W.word_hashes(low, starts[longer], cut[longer]) + np.uint64(n)), at


def stems(texts: pa.Array) -> np.ndarray:
    """Distinct hashes of all word beginnings."""
    data, bounds = W.text_bytes(texts)
    starts, ends, first = W.letters_bounds(data, bounds)
    return np.unique(np.concatenate([beginnings(W.lowered(data), starts, ends, first, n)[0] for n in BEGINNINGS]))


def distinct_features(texts: pa.Array) -> list[np.ndarray]:
    data, bounds = W.text_bytes(texts)
    out = []
    for low, high in W.slices(bounds):
        found, at = features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
        out += [np.unique(found[x:y]) for x, y in zip(at, at[1:], strict=False)]
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def risk(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The corrected risk of scores, and the direction of a step for each score.

    Where the corrected negative part is below zero the direction is that of raising it.
    """
    own, share = prior / len(z_pos), 1 / len(z_unl)
    negative = np.logaddexp(0, z_unl).sum() * share - np.logaddexp(0, z_pos).sum() * own
    value = np.logaddexp(0, -z_pos).sum() * own + max(0.0, negative)
    as_negative = _sigmoid(z_unl) * share, -_sigmoid(z_pos) * own
    if negative < 0:
        return value, -as_negative[1], -as_negative[0]
    return value, as_negative[1] - _sigmoid(-z_pos) * own, as_negative[0]


class Rows:
    """Texts as sets of numbers of the words in ``names``."""

    def __init__(self, texts: list[np.ndarray], names: np.ndarray):
        flat = np.concatenate([*texts, np.zeros(0, np.uint64)])
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
        known = names[at] == flat if len(names) else np.zeros(len(flat), bool)
        self.row, self.at, self.count, self.names = row[known], at[known], len(texts), len(names)

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, weights[self.at], self.count)

    def to_words(self, direction: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, direction[self.row], self.names)


def descend(pos: Rows, unl: Rows, prior: float, steps: int, shrink: float | np.ndarray, p: PosUnl) -> tuple[np.ndarray, float]:
    """Weights and bias after steps with a rate of its own for each word, shrunk by the lasso."""
    weights, bias = np.zeros(pos.names), -2.0
    seen, seen_bias = np.full(pos.names, 1e-8), 1e-8
    for _ in range(steps):
        _, d_pos, d_unl = risk(pos.scores(weights, bias), unl.scores(weights, bias), prior)
        slope, slope_bias = pos.to_words(d_pos) + unl.to_words(d_unl), d_pos.sum() + d_unl.sum()
        seen, seen_bias = seen + slope**2, seen_bias + slope_bias**2
        rate = p.rate / np.sqrt(seen)
        weights = weights - rate * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * shrink * prior, 0)
        bias -= p.rate / np.sqrt(seen_bias) * slope_bias
    return weights, float(bias)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, p: PosUnl, dear: np.ndarray | None = None) -> Model:
    """Select words with the lasso, which is harder on those in ``dear``, then fit those again."""
    names, held = np.unique(np.concatenate([*positive, np.zeros(0, np.uint64)]), return_counts=True)
    names = names[held >= max(p.least_rows, p.least_share * len(positive))]
    shrink = max(p.lasso, p.error / np.sqrt(len(positive)))
    each = shrink * np.where(np.isin(names, [] if dear is None else dear), p.stem, 1.0)
    weights, _ = descend(Rows(positive, names), Rows(unlabelled, names), prior, p.steps[0], each, p)
    names = names[weights > 0]
    weights, bias = descend(Rows(positive, names), Rows(unlabelled, names), prior, p.steps[1], p.again * shrink, p)
    return names, weights, bias


def _fold(p: PosUnl) -> Column:
    """Whether a row's id is in the held-out fold; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(p.folds)) == p.held_fold, F.lit(False))


def _samples(docs: DataFrame, labels: DataFrame, p: PosUnl) -> tuple[DataFrame, float]:
    """member, positive, spot and text of all training rows, and the class prior; no row of the held-out fold."""
    marked = labels.filter(~_fold(p)).filter("toxic is not null and doc_id is not null")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    prior = marked.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(~_fold(p))
    rows = rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= p.sample_chars)

    known = marked.filter("toxic > 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    known = stage(known.orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.positives), "positives")
    examples = only_ids(rows, known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    examples = examples.select(
        F.explode(F.sequence(F.lit(0), F.lit(p.members - 1))).alias("member"), F.lit(True).alias("positive"),
        F.xxhash64("doc_id").alias("spot"), "text",
    )
    # rows with small hashes, as many as four times the sample among all rows, are made distinct and cut
    wanted = p.members * p.unlabelled
    most = min(2**63 - 1, 4 * wanted * 2**64 // max(1, docs.count()) - 2**63)
    spot = F.xxhash64("doc_id", "text", F.lit(p.seed))
    low = rows.select(spot.alias("spot"), "text").filter(F.col("spot") <= most)
    drawn = stage(low.select("spot").distinct().orderBy("spot").limit(wanted), "unlabelled")
    free = only_ids(low, drawn, "spot").groupBy("spot").agg(F.min("text").alias("text"))
    free = free.select(F.pmod(F.xxhash64("spot"), F.lit(p.members)).cast("int").alias("member"), F.lit(False).alias("positive"), "spot", "text")
    return examples.unionByName(free), prior


def train(docs: DataFrame, labels: DataFrame, p: PosUnl = PosUnl()) -> Model:
    """The averaged classifier; each member is one task over a bounded sample."""
    bounded_batches(docs.sparkSession)
    rows, prior = _samples(docs, labels, p)
    bare = np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("positive", "ascending"), ("spot", "ascending")])
        known = table["positive"].to_numpy(zero_copy_only=False)
        texts = distinct_features(table["text"])
        pos, unl = texts[int((~known).sum()) :], texts[: int((~known).sum())]
        names, weights, bias = fit(pos, unl, prior, p, stems(table["text"].filter(table["positive"]))) if pos and unl else bare
        return pa.table({"names": [names.tobytes()], "weights": [weights.tobytes()], "bias": [bias], "fitted": [bool(pos and unl)]})

    found = rows.groupBy("member").applyInArrow(run, "names binary, weights binary, bias double, fitted boolean").filter("fitted").collect()
    if not found:
        return bare
    all_names = np.concatenate([np.frombuffer(r.names, np.uint64) for r in found])
    names, at = np.unique(all_names, return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(r.weights, np.float64) for r in found]), len(names))
    return names, total / len(found), float(np.mean([r.bias for r in found]))


def score(docs: DataFrame, model: Model, p: PosUnl = PosUnl()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the model has at most the words that the samples' positives share."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, weights, bias = shared.value
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(2))
            total = np.full(batch.num_rows, bias)
            for low, high in W.slices(bounds):
                found, at = features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
                spot = np.flatnonzero(np.isin(found, names))
                row = np.searchsorted(at, spot, "right") - 1
                once = np.unique(np.stack([row, np.searchsorted(names, found[spot])]), axis=1)
                total[low:high] += np.bincount(once[0], weights[once[1]], high - low)
            chance = _sigmoid(total)
            columns = [batch.column(0), batch.column(1), pa.array(chance), pa.array((chance >= p.threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fold(p).alias("held_out"), "text")
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
