"""Token counts of whole texts by the tokenizer libraries, lengths only.

Texts arrive in Arrow batches and are handled in portions of about ``PORTION`` bytes, so one long
text costs no more memory than many short ones.  For a tokenizer that drops white space and never
joins across it (``words=True``), ASCII white space is a safe place to split any text: each portion's
distinct pieces are encoded once, in lines of about ``LINE`` bytes, and a text's count is
the sum over its pieces.  Counts of pieces are kept by the worker for later batches, up to a bound.
Other tokenizers get whole texts, in batches balanced by bytes.

Defined results: null is the empty text with 0 bytes and 0 tokens.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import bounded_batches

PORTION = 4 << 20
LINE = 1 << 13
KEPT_PIECES = 2_000_000


class Pieces:
    """Token counts of white-space separated pieces, each encoded once while it is kept."""

    def __init__(self, path: str):
        self.encode = load(path)
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def totals(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        starts, ends, first = W.word_bounds(data, bounds)
        if not len(starts):
            return np.zeros(len(bounds) - 1, np.int64)
        names, where, inverse = np.unique(W.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, names)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == names[known]
        counts = np.zeros(len(names), np.int64)
        counts[known] = self.counts[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = data.tobytes()
            texts = [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in where[fresh].tolist()]
            counts[fresh] = self._count(texts)
            self._keep(names[fresh], counts[fresh])
        sums = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts[inverse], out=sums[1:])
        return sums[first[1:]] - sums[first[:-1]]

    def _count(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece, from lines that hold many of them."""
        sizes = np.array([len(x) for x in pieces])
        group = np.fromiter(accumulate(sizes.tolist(), lambda s, n: s + n + 1), np.int64) // LINE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(pieces)]
        lines = [pieces[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        out = []
        for line, offsets in zip(lines, self.encode([" ".join(x) for x in lines]), strict=True):
            begin = np.zeros(len(line), np.int64)
            np.cumsum([len(x) + 1 for x in line[:-1]], out=begin[1:])
            out.append(np.bincount(np.searchsorted(begin, offsets, "right") - 1, minlength=len(line)))
        return np.concatenate(out)

    def _keep(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > KEPT_PIECES:
            self.hashes, self.counts = self.hashes[:0], self.counts[:0]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.counts = np.insert(self.hashes, at, hashes), np.insert(self.counts, at, counts)


def load(path: str):
    """texts -> for each text the character offsets at which its tokens start."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [[x for x, _ in e.offsets] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _whole(path: str):
    """texts -> token counts, by the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_LOADED: dict[tuple, object] = {}


def _counter(path: str, words: bool):
    """The worker's counter, loaded once: (bytes, bounds) -> tokens of each text."""
    if (path, words) not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        if words:
            _LOADED[path, words] = Pieces(path).totals
        else:
            encode = _whole(path)

            def totals(data, bounds):
                raw = data.tobytes()
                return np.array(encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]), np.int64)

            _LOADED[path, words] = totals
    return _LOADED[path, words]


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, words: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    ``words`` states that the tokenizer drops white space and never joins across it.
    """

    def run(batches):
        count = _counter(path, words)
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            for low, high in W.slices(bounds, PORTION):
                tokens[low:high] = count(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
            columns = [batch.column(0), pa.array(np.diff(bounds)), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
