"""Words of Arrow text columns as numpy arrays: bounds, 64-bit hashes and n-gram hashes.

A text column is read straight from its Arrow buffers, so no text becomes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # texts are handled in slices of about this size, which fit a core's cache
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: bytes that end a word of letters, digits and non-ASCII characters
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(count: int, seed: int) -> np.ndarray:
    """``count`` odd 64-bit multipliers that depend on the seed only."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) | np.uint64(1)


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; null is the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own.

    Arrow's free memory goes back to the system afterwards, as workers live on between stages.
    """
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield low, min(high, rows)
        low = min(high, rows)
    pa.default_memory_pool().release_unused()


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, ...]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    word = ~between[data]
    inner = np.zeros(len(data) + 1, bool)  # true where a word goes on from the byte before
    inner[1:-1] = word[:-1] & word[1:]
    inner[bounds] = False
    starts = np.flatnonzero(word & ~inner[:-1])
    ends = np.flatnonzero(word & ~inner[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def letters_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``word_bounds`` for words of letters, digits and non-ASCII characters."""
    return word_bounds(data, bounds, _PUNCT)


_BLOCK = 64  # bytes of a word that are hashed in one chain; a longer word is the word of its blocks' hashes
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes: chained over eight bytes at a time, without a structure that words could meet in."""
    size = ends - starts
    long = np.flatnonzero(size > _BLOCK)
    if not len(long):
        return _chained(data, starts, size)
    out = np.empty(len(starts), np.uint64)
    short = np.flatnonzero(size <= _BLOCK)
    out[short] = _chained(data, starts[short], size[short])
    blocks = -(-size[long] // _BLOCK)
    last = np.cumsum(blocks)
    nth = np.arange(last[-1]) - np.repeat(last - blocks, blocks)
    begin = np.repeat(starts[long], blocks) + nth * _BLOCK
    inner = _chained(data, begin, np.minimum(np.repeat(ends[long], blocks) - begin, _BLOCK)).view(np.uint8)
    out[long] = mix(word_hashes(inner, (last - blocks) * 8, last * 8) + size[long].astype(np.uint64))
    return out


def _chained(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words of ``_BLOCK`` bytes at most."""
    total = mix(size.astype(np.uint64) + np.uint64(_BASE))
    if not len(starts) or not len(data):
        return total
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from every place on
    for k in range(0, int(size.max()), 8):
        on = np.flatnonzero(size > k) if k else slice(None)
        at, left = starts[on] + k, size[on] - k
        part = eight[np.minimum(at, len(data))] & _LOW_BYTES[np.clip(left, 0, 8)]
        total[on] = mix(total[on] * np.uint64(_BASE) + part)
    return total


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of byte windows of one short length, from one running sum over all bytes.

    A sieve for windows that may overlap: equal windows have equal hashes, and callers compare bytes.
    """
    powers = np.full(len(data) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers[:-1], out=sums[1:])
    # each window's sum is brought to the power of the last place
    return mix((sums[starts + length] - sums[starts]) * powers[len(data) - starts])


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's runs of ``n`` words, and for each text the index of its first run.

    ``first`` holds each text's first word (one more at the end).  A text of fewer words, but
    not none, has one run of all its words if ``short`` is true, else none.
    """
    counts = np.diff(first)
    runs = np.maximum(counts - n + 1, 0)
    if short:
        runs[(counts > 0) & (counts < n)] = 1
    at = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    begin = np.repeat(first[:-1] - at[:-1], runs) + np.arange(at[-1])
    if not len(begin):
        return np.zeros(0, np.uint64), at
    size = np.minimum(np.repeat(counts, runs), n)
    total = size.astype(np.uint64)
    for k in range(n):
        word = words[np.minimum(begin + k, len(words) - 1)]
        total = np.where(k < size, mix(total * np.uint64(_BASE) + word), total) if short else mix(total * np.uint64(_BASE) + word)
    return total, at
