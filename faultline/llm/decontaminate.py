"""Benchmark decontamination by suffix arrays over shards of the training text.

Each shard (about ``SHARD`` bytes of whole documents) gets a suffix array of its words: the suffixes
in order, here only those that begin as some benchmark window does, since no other can match.  Every
benchmark suffix is searched by bisection; the suffixes between both bounds are all its verbatim
matches.  Matches on one diagonal merge, so the longest match at each place is known with its
location.  A window is ``window`` consecutive item words; an item of fewer words is one window.

The benchmark is searched in blocks that hold at most twice ``BLOCK_BYTES`` of text, or one item that is longer,
so each broadcast has a counted bound; the work in a shard does not depend on how its documents are distributed, and
no document is shuffled.  Defined results: null has no words and no hits; items without id or text are ignored, and
of items equal in id and text one counts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import stage

from . import words as W
from .tables import bounded_batches

SHARD = 4 << 20
BLOCK_BYTES = 16 << 20


@dataclass(frozen=True)
class Windows:
    """Distinct windows of a block of items, and the items each belongs to."""

    keys: np.ndarray  # big-endian words of each distinct window, padded with zeros
    size: np.ndarray
    item_at: np.ndarray  # items of window k: items[item_at[k]:item_at[k + 1]]
    items: np.ndarray
    places: np.ndarray  # each item's word position of the window
    names: list[str]
    begins: list[np.ndarray]  # sorted hashes of the first one, two and three words of the windows


def item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = W.text_bytes(pa.array(texts, pa.string()))
    data = W.lowered(data)
    starts, ends, first = W.letters_bounds(data, bounds)
    return _nonzero(W.word_hashes(data, starts, ends)), first


def _nonzero(hashes: np.ndarray) -> np.ndarray:
    return np.maximum(hashes, np.uint64(1))  # 0 stands for the end of a text


def _keys(words: np.ndarray, begin: np.ndarray, stop: np.ndarray, window: int) -> np.ndarray:
    """The words from ``begin`` on, up to ``stop``, as byte strings that sort as the words do."""
    out = np.zeros((len(begin), window), ">u8")
    padded = np.append(words, np.zeros(1, np.uint64))
    for k in range(window):
        out[:, k] = padded[np.where(begin + k < stop, begin + k, len(words))]
    return out.view(f"S{8 * window}").ravel()


def _beginnings(words: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(begin), np.uint64)
    for k in range(n):
        total = W.mix(total * np.uint64(31) + words[begin + k])
    return total


def _among(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``names``; most are ruled out by their low bits."""
    low = np.uint64((1 << 20) - 1)
    table = np.zeros(1 << 20, bool)
    table[(names & low).astype(np.int64)] = True
    out = table[(values & low).astype(np.int64)]
    at = np.flatnonzero(out)
    spot = np.searchsorted(names, values[at])
    out[at] = names[np.minimum(spot, len(names) - 1)] == values[at]
    return out


def windows_of(rows: list[tuple], window: int) -> Windows:
    """All windows of (item_id, text) rows."""
    words, first = item_words([text for _, text in rows])
    counts = np.diff(first)
    runs = np.where(counts >= window, counts - window + 1, (counts > 0).astype(int))
    item = np.repeat(np.arange(len(rows)), runs)
    place = np.arange(len(item)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin, stop = first[:-1][item] + place, first[1:][item]
    size = np.minimum(counts[item], window)
    keys = _keys(words, begin, np.minimum(stop, begin + window), window)
    # a window is the same only if its length is: a short item is a prefix of longer windows, not one of them
    named = np.rec.fromarrays([keys, size], names="key,size")
    _, where, inverse = np.unique(named, return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    item_at = np.zeros(len(where) + 1, np.int64)
    np.cumsum(np.bincount(inverse, minlength=len(where)), out=item_at[1:])
    begins = [np.unique(_beginnings(words, begin[size >= n] if n == 3 else begin[size == n], n)) for n in (1, 2, 3)]
    return Windows(keys[where], size[where], item_at, item[order], place[order], [str(i) for i, _ in rows], begins)


def search(words: np.ndarray, first: np.ndarray, block: Windows, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position) of every occurrence in the shard's texts."""
    n = len(words)
    stop = np.repeat(first[1:], np.diff(first))
    chosen = np.zeros(n, bool)
    at = np.arange(n)
    for k, names in enumerate(block.begins, 1):
        if len(names):
            fit = at[at + k <= stop]
            chosen[fit] |= _among(_beginnings(words, fit, k), names)
    suffixes = np.flatnonzero(chosen)
    keys = _keys(words, suffixes, stop[suffixes], window)
    order = np.argsort(keys, kind="stable")  # the shard's suffix array
    suffixes, keys = suffixes[order], keys[order]
    low = np.searchsorted(keys, block.keys, "left")
    top = block.keys.view(">u8").reshape(len(block.keys), window).copy()
    top[np.arange(window)[None] >= block.size[:, None]] = np.iinfo(np.uint64).max
    high = np.searchsorted(keys, top.view(block.keys.dtype).ravel(), "right")
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    spots = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    return which, suffixes[spots]


def longest(which: np.ndarray, where: np.ndarray, text: np.ndarray, block: Windows) -> np.ndarray:
    """Rows (item, item word, text, word, length) of the maximal verbatim matches."""
    count = np.diff(block.item_at)[which]
    pick = np.repeat(block.item_at[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item, place, at = block.items[pick], block.places[pick], np.repeat(where, count)
    size, text = np.repeat(block.size[which], count), np.repeat(text, count)
    order = np.lexsort((place, at - place, text, item))
    item, place, at, size, text = item[order], place[order], at[order], size[order], text[order]
    new = np.ones(len(item), bool)
    same = (item[1:] == item[:-1]) & (text[1:] == text[:-1]) & (at[1:] - place[1:] == at[:-1] - place[:-1]) & (place[1:] == place[:-1] + 1)
    new[1:] = ~same
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(item)) - 1
    return np.stack([item[begin], place[begin], text[begin], at[begin], place[end] - place[begin] + size[end]], 1) if len(begin) else np.zeros((0, 5), np.int64)


SCHEMA = "doc_id long, row_key long, n_words long, hits array<int>, items array<string>, matches array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"


def scan(docs: DataFrame, block: Windows, window: int = 13, matches: bool = False, final: bool = False) -> DataFrame:
    """Per row: word count, hit word ranges (begin, end, ...), items and, if asked for, the longest matches.

    With ``final``, where there is one block only, ranges and items become counts and digests at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        items = shared.value
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(2))
            for low, high in W.slices(bounds, SHARD):
                chunk = W.lowered(data[bounds[low] : bounds[high]])
                starts, ends, first = W.letters_bounds(chunk, bounds[low : high + 1] - bounds[low])
                words = _nonzero(W.word_hashes(chunk, starts, ends))
                which, where = search(words, first, items, window)
                text = np.searchsorted(first, where, "right") - 1
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, where, 1)
                np.add.at(cover, where + items.size[which], -1)
                hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                found = [[] for _ in range(high - low)]
                ranges: list[list[int]] = [[] for _ in found]
                named: list[list[str]] = [[] for _ in found]
                for t in np.unique(text).tolist():
                    own = hit[first[t] + 1 : first[t + 1] + 1]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                    ranges[t] = edges.tolist()
                pairs = np.unique(np.stack([text, which], 1), axis=0)
                for t, k in pairs.tolist():
                    named[t].extend(items.names[i] for i in items.items[items.item_at[k] : items.item_at[k + 1]])
                if matches:
                    for i, place, t, at, size in longest(which, where, text, items).tolist():
                        found[t].append({"item_id": items.names[i], "item_word": place, "doc_word": at - int(first[t]), "n_words": size})
                done = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array(np.diff(first)),
                        *(pa.array(v, arrow.field(k).type) for k, v in (("hits", ranges), ("items", [sorted(set(x)) for x in named]), ("matches", found))),
                    ],
                    schema=arrow,
                )
                yield from _finish([done]) if final else [done]

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, _FINAL if final else SCHEMA)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))


def _blocks(items: DataFrame, block_bytes: int) -> int:
    """How many blocks the items are dealt into, so that none holds more than twice ``block_bytes`` or one long item."""
    size = F.octet_length("text")
    total, longest_item = items.agg(F.sum(size), F.max(size)).first()
    blocks = -(-int(total or 0) // block_bytes) or 1
    while blocks > 1:
        sizes = items.groupBy(_block(blocks)).agg(F.sum(size).alias("size"), F.count("*").alias("rows"))
        if sizes.filter((F.col("size") > max(2 * block_bytes, longest_item)) & (F.col("rows") > 1)).isEmpty():
            break
        blocks *= 2
    return blocks


def shown_matches(found: DataFrame) -> DataFrame:
    """``matches`` as text: item:item_word:doc_word:n_words, by place in the document, joined by commas; and their number.

    ``longest_match`` is the number of words of the longest, 0 without any.
    """
    order = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"], m["item_id"], m["item_word"], m["n_words"])))
    text = F.array_join(F.transform(order, lambda m: F.concat_ws(":", m["item_id"], m["item_word"], m["doc_word"], m["n_words"])), ",")
    return found.select(
        *[c for c in found.columns if c != "matches"], F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.col("matches.n_words")), F.lit(0)).cast("long").alias("longest_match"), text.alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, matches: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and the longest matches) of every row.

    A row is contaminated if some word is hit and 20 * n_hit >= n_words.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    blocks = _blocks(items, block_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    parts = []
    for k in range(blocks):
        mine = items.filter(_block(blocks) == k) if blocks > 1 else items
        part = scan(rows, windows_of([tuple(r) for r in mine.collect()], window), window, matches, blocks == 1)
        parts.append(stage(part, "hits") if blocks > 1 else part)
    if blocks == 1:
        return parts[0] if matches else parts[0].drop("matches")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # a row's hits in several blocks are united; equal rows stay as many as they were
    out = out.groupBy("doc_id", "row_key").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"),
        (F.count("*") / blocks).cast("int").alias("copies"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    found = out.select("doc_id", "n_words", "hits", "items", "matches").mapInArrow(_finish, _FINAL)
    return found if matches else found.drop("matches")


_FINAL = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "matches array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"
)


def _finish(batches):
    for batch in batches:
        words = batch.column("n_words").to_numpy()
        hit = np.array([_covered(x) for x in batch.column("hits").to_pylist()], np.int64)
        items = [sorted(x) for x in batch.column("items").to_pylist()]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        columns = [
            batch.column("doc_id"), batch.column("n_words"), pa.array(hit), pa.array([len(x) for x in items], pa.int64()),
            pa.array(digest, pa.string()), pa.array((hit > 0) & (20 * hit >= words)), batch.column("matches"),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _FINAL.split(", ")])


def _covered(edges: list[int]) -> int:
    """Words inside at least one of the ranges (begin, end, begin, end, ...)."""
    total, reach = 0, 0
    for low, high in sorted(zip(edges[::2], edges[1::2], strict=True)):
        total += max(0, high - max(low, reach))
        reach = max(reach, high)
    return total
