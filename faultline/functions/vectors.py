"""Vectors of texts: hashed words with sublinear weights under a random projection.

A word's weight is 1 + ln(occurrences).  Its 64 signs are bits of its MD5 digest, so the projection needs no table and is the
same in every task and session.  A text's vector is the weighted sum of its words' signs, scaled to length 1.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64
WORD = r"[0-9A-Za-z_\x80-\U0010FFFF]+"
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@lru_cache(maxsize=1 << 16)
def word_signs(word: str) -> np.ndarray:
    """+1 for each set bit of the first eight bytes of the word's digest, lowest bit first, else -1."""
    bits = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
    return np.array([1.0 if bits >> d & 1 else -1.0 for d in range(DIMENSIONS)])


def text_vector(text: str | None) -> np.ndarray:
    """Vector of one text; a text without words has the zero vector."""
    counts = Counter(_WORD.findall((text or "").translate(_LOWER)))
    if not counts:
        return np.zeros(DIMENSIONS)
    weights = 1 + np.log(np.fromiter(counts.values(), float))
    total = weights @ np.stack([word_signs(w) for w in counts])
    length = np.sqrt(total @ total)
    return total / length if length else total


def text_vectors(text: Column) -> Column:
    """``text_vector`` of whole Arrow batches."""

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([text_vector(t).tolist() for t in texts.to_pylist()], pa.list_(pa.float64()))

    return vectors(text)


def squared_distances(bodies: Column, asked: Column) -> Column:
    """Exact squared L2 distance of each body's vector to that of ``asked``, per row, to six places.

    Where only one of the two has words, they are as far apart as vectors can be: 4.
    """

    @F.arrow_udf("array<double>")
    def distances(lists: pa.Array, asks: pa.Array) -> pa.Array:
        out = []
        for texts, ask in zip(lists.to_pylist(), asks.to_pylist(), strict=True):
            if not texts:
                out.append([])
                continue
            bodies, query = np.stack([text_vector(t) for t in texts]), text_vector(ask)
            gaps = bodies - query
            far = np.where(bodies.any(1) == query.any(), (gaps * gaps).sum(1), 4.0)
            out.append(np.round(far, 6).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return distances(bodies, asked)
