"""Quality scores by logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Two word streams are hashed: the lower-cased words and their forms (letters, capitals, digits as
classes, runs of one class cut to one).  Each stream gives single words and pairs.  A text's vector holds
its n-gram counts divided by their number, so a score is one sparse dot product with the weights.

Training takes a bounded sample of labelled rows (``sample_docs``, lowest hashes first, each text
whole) to one task; scoring covers every row.  Defined results: null or wordless text has an empty vector
and gets the score of the bias alone; without any labelled rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import bounded_batches, only_ids


@dataclass(frozen=True)
class Ftrl:
    buckets: int = 1 << 18
    sample_docs: int = 4000
    sample_chars: int = 50_000  # only documents of at most so many characters are drawn for the sample
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    scale: float = 20.0  # length of a text's vector before the dot product
    folds: int = 5
    threshold: float = 0.3


_FORM = np.arange(256, dtype=np.uint8)
_FORM[ord("a") : ord("z") + 1] = ord("a")
_FORM[ord("A") : ord("Z") + 1] = ord("A")
_FORM[ord("0") : ord("9") + 1] = ord("0")
_FORM[0x80:] = ord("a")


def features(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram and, for each text, where its n-grams begin (one more at the end)."""
    form = _FORM[data]
    keep = np.ones(len(form), bool)
    keep[1:] = (form[1:] != form[:-1]) | (form[1:] <= 0x20)
    keep[bounds[:-1][bounds[:-1] < len(form)]] = True
    moved = np.zeros(len(form) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    parts = []
    for salt, stream, at in ((1, W.lowered(data), bounds), (2, form[keep], moved[bounds])):
        starts, ends, first = W.word_bounds(stream, at)
        words = W.word_hashes(stream, starts, ends)
        for n in (1, 2):
            grams, begin = W.ngram_hashes(words, first, n, short=False)
            parts.append(((W.mix(grams + np.uint64(salt * 10 + n)) & np.uint64(buckets - 1)).astype(np.int64), begin))
    counts = sum(np.diff(begin) for _, begin in parts)
    out_at = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=out_at[1:])
    out, used = np.empty(out_at[-1], np.int64), out_at[:-1].copy()
    for grams, begin in parts:
        n = np.diff(begin)
        out[np.repeat(used - begin[:-1], n) + np.arange(len(grams))] = grams
        used = used + n
    return out, out_at


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: Ftrl) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of follow-the-regularised-leader updates."""
    z, n = np.zeros(p.buckets + 1), np.zeros(p.buckets + 1)

    def weights(at):
        zi = z[at]
        shrunk = np.sign(zi) * p.l1 - zi
        return np.where(np.abs(zi) <= p.l1, 0.0, shrunk / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for (at, x), y in zip(vectors, labels, strict=True):
            w = weights(at)
            g = (_sigmoid(w @ x) - y) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / p.alpha * w
            n[at] = grown
    all_weights = weights(np.arange(p.buckets + 1))
    return all_weights[:-1], float(all_weights[-1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _vectors(texts: pd.Series, p: Ftrl) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vectors with the bias as the last entry."""
    out = []
    data, bounds = W.text_bytes(pa.array(texts, pa.string()))
    for low, high in W.slices(bounds):
        grams, at = features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], p.buckets)
        for a, b in zip(at, at[1:], strict=False):
            names, counts = np.unique(grams[a:b], return_counts=True)
            out.append((np.append(names, p.buckets), np.append(p.scale * counts / max(1, b - a), 1.0)))
    return out


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """Fit on the rows outside the held-out fold (crc32 of the id's text, modulo ``folds``, is not 0)."""
    open_rows = labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(p.folds)) != 0).filter("quality is not null")
    marked = open_rows.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_docs)
    rows = only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), drawn, "doc_id", "inner", p.sample_docs)
    rows = rows.filter(F.length(F.coalesce("text", F.lit(""))) <= p.sample_chars).select("doc_id", "text", "quality", F.lit(0).alias("one"))

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.drop_duplicates("doc_id").sort_values("doc_id")
        order = np.argsort(W.mix(sample["doc_id"].to_numpy().astype(np.uint64)))
        sample = sample.iloc[order]
        weights, bias = ftrl(_vectors(sample["text"].fillna(""), p), (sample["quality"] > 0).to_numpy(float), p)
        return pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    found = rows.groupBy("one").applyInPandas(run, "weights binary, bias double").collect()
    if not found:
        return np.zeros(p.buckets, np.float32), 0.0
    return np.frombuffer(found[0].weights, np.float32), found[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], p: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the weights have a fixed size."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(2))
            total = np.zeros(batch.num_rows)
            for low, high in W.slices(bounds):
                grams, at = features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], p.buckets)
                count = np.diff(at)
                full = np.flatnonzero(count)
                if len(full):
                    sums = np.add.reduceat(weights[grams], at[full], dtype=np.float64)
                    total[low + full] = p.scale * sums / count[full]
            chance = _sigmoid(total + bias)
            columns = [batch.column(0), batch.column(1), pa.array(chance), pa.array((chance >= p.threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(p.folds)) == 0, F.lit(False))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
