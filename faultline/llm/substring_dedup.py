"""Removal of repeated byte strings, decided by suffix arrays over content-keyed parts of the corpus.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Equal texts: all but the one with the smallest id go whole (texts below ``length`` bytes stay).
2. Every window of ``length`` bytes names the smallest hash of its inner ``anchor``-byte strings.
   Equal windows name the same anchor wherever they stand.  Anchors that occur in one document only are out; this
   sieve moves four bytes an anchor, not the text.
3. A run of windows that name one anchor is a segment.  Segments travel to their anchor, equal ones
   once per Arrow batch with the smallest and largest id.
4. There, windows that differing segments may share (by hash) are cut out, again from the differing cut-outs while that
   leaves less, and a suffix array of what is left, built by linear grouping, brings equal windows next to each
   other; neighbours that agree in ``length`` bytes form a run, and the run's smallest id is the window's.
5. Each occurrence with a larger id than its window's is removed; ranges of a document are united.

Texts are laid out once in buckets by row, so neither of the two later passes shuffles them.
Equal texts are known by a 128-bit digest and equal segments by a 64-bit hash (``words.word_hashes``, which has no
structural collisions); between differing segments bytes are compared, so there hashes only rule out.

Defined results: null text is empty; a null id is never smaller than another and loses nothing; rows of
one id do not remove each other.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import stage, work_dir

from . import words as W
from .suffix_array import suffix_array
from .tables import bounded_batches, keyed_groups, only_ids


@dataclass(frozen=True)
class Repeats:
    length: int = 50
    anchor: int = 20
    bucket_bytes: int = 32 << 20  # of text per bucket
    part_bytes: int = 8 << 20  # of segments per group of anchors
    array_bytes: int = 1 << 18  # of text per suffix array, if whole anchors allow


def window_anchors(data: np.ndarray, bounds: np.ndarray, p: Repeats) -> tuple[np.ndarray, ...]:
    """Segments of all texts: anchor hash, text, first byte and number of windows of each."""
    n, k, length = len(data), p.anchor, p.length
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty, empty, empty
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.empty(n + 8, np.uint64)
    for j in range(8):
        part = np.frombuffer(padded.tobytes() if j == 0 else raw, "<u8", offset=j, count=(len(padded) - j) // 8)
        raw = padded.tobytes() if j == 0 else raw
        spot = eight[j::8]
        spot[:] = part[: len(spot)]
    a, b, c = (np.uint64(x) for x in W.constants(3, 71))
    grams = eight[: n - k + 1] * a
    grams += np.roll(eight, -8)[: n - k + 1] * b
    grams ^= grams >> np.uint64(29)
    grams += eight[k - 8 : n - 7] * c
    grams = W.mix(grams)
    width, least, step = length - k + 1, grams, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[: len(least)] == text[length - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    after = np.append(np.flatnonzero(new | ~whole), len(least))
    end = after[np.searchsorted(after, first, "right")]
    return least[first], text[first], first, end - first


def _batches(batches, columns: int, p: Repeats):
    """(batch, first row, last row, bytes, bounds) of every slice; the last column is the text."""
    for batch in batches:
        data, bounds = W.text_bytes(batch.column(columns))
        for low, high in W.slices(bounds, 1 << 20):
            yield batch, low, high, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]


def _marks(docs: DataFrame, buckets: int, p: Repeats) -> DataFrame:
    """Anchors of all rows by bucket: rows (key, id), anchors per row and the low halves of the anchors."""

    def run(batches):
        for batch, low, high, data, bounds in _batches(batches, 2, p):
            anchors, text, _, _ = window_anchors(data, bounds, p)
            pair = np.unique(np.stack([text.astype(np.uint64), anchors], 1), axis=0) if len(text) else np.zeros((0, 2), np.uint64)
            text, anchors = pair[:, 0].astype(np.int64), pair[:, 1]
            bucket = ((anchors >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((text, bucket))
            text, anchors, bucket = text[order], anchors[order].astype(np.uint32), bucket[order]
            keys = batch.column(0).slice(low, high - low).to_numpy()
            ids = batch.column(1).slice(low, high - low).to_numpy()
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            rows = {"bucket": [], "keys": [], "ids": [], "counts": [], "anchors": []}
            for x, y in zip(cuts, cuts[1:], strict=False):
                names, counts = np.unique(text[x:y], return_counts=True)
                rows["bucket"].append(int(bucket[x]))
                rows["keys"].append(keys[names].tobytes())
                rows["ids"].append(ids[names].tobytes())
                rows["counts"].append(counts.astype(np.uint32).tobytes())
                rows["anchors"].append(anchors[x:y].tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "counts", "anchors"))])
    return docs.select("row_key", "doc_id", "text").mapInArrow(run, "bucket int, keys binary, ids binary, counts binary, anchors binary")


def _shared(marks: DataFrame) -> DataFrame:
    """(row_key, anchor) of the anchors that occur in several documents."""

    def run(batches):
        for group in keyed_groups(batches, "bucket"):
            read = lambda c, kind: np.frombuffer(b"".join(group[c].to_pylist()), kind)  # noqa: B023, E731
            counts = read("counts", np.uint32)
            keys, ids = np.repeat(read("keys", np.int64), counts), np.repeat(read("ids", np.int64), counts)
            anchors = read("anchors", np.uint32)
            order = np.argsort(anchors, kind="stable")
            keys, ids, anchors = keys[order], ids[order], anchors[order]
            cuts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
            several = np.minimum.reduceat(ids, cuts) != np.maximum.reduceat(ids, cuts)
            keep = np.repeat(several, np.diff(np.append(cuts, len(anchors))))
            name = (np.int64(group["bucket"][0].as_py()) << np.int64(32)) | anchors[keep].astype(np.int64)
            for x in range(0, len(name), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep][x : x + 65536]), pa.array(name[x : x + 65536])], ["row_key", "anchor"])

    return marks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "row_key long, anchor long")


def _chosen(batches, buckets: int, p: Repeats):
    """Segments whose anchor is shared: (row in slice, anchor, first byte, windows), with the slice."""
    for batch, low, high, data, bounds in _batches(batches, 3, p):
        anchors, text, first, count = window_anchors(data, bounds, p)
        name = (((anchors >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << np.int64(32)) | (anchors & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lists = batch.column(2).slice(low, high - low)
        shared = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(high - low), pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        known = np.unique(W.mix(shared.astype(np.uint64)) + owner.astype(np.uint64) * np.uint64(W._BASE))
        asked = W.mix(name.astype(np.uint64)) + text.astype(np.uint64) * np.uint64(W._BASE)
        at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
        keep = known[at] == asked if len(known) else np.zeros(len(asked), bool)
        yield batch, low, high, data, bounds, anchors[keep].astype(np.int64), text[keep], first[keep], count[keep]


def _segment_keys(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return W.word_hashes(data, first, end).astype(np.int64)


def _segments(docs: DataFrame, buckets: int, parts: int, p: Repeats) -> DataFrame:
    """Distinct segments of each slice with the smallest and largest id that holds them."""

    def run(batches):
        for batch, low, high, data, bounds, anchor, text, first, count in _chosen(batches, buckets, p):
            ids = batch.column(1).slice(low, high - low).to_numpy()[text]
            keys = _segment_keys(data, first, first + count + p.length - 1)
            order = np.lexsort((ids, keys, anchor))
            anchor, keys, ids, first, count = anchor[order], keys[order], ids[order], first[order], count[order]
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (anchor[1:] != anchor[:-1])])) if len(keys) else np.zeros(0, int)
            last = np.append(cuts[1:], len(keys)) - 1
            raw = data.tobytes()
            strings = [raw[a : a + c + p.length - 1] for a, c in zip(first[cuts].tolist(), count[cuts].tolist(), strict=True)]
            columns = [(anchor[cuts] % parts), anchor[cuts], keys[cuts], ids[cuts], ids[last]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(strings, pa.binary())], names)

    names = ["part", "anchor", "segment", "low", "high", "string"]
    return docs.mapInArrow(run, "part long, anchor long, segment long, low long, high long, string binary")


def _occurrences(docs: DataFrame, buckets: int, p: Repeats) -> DataFrame:
    def run(batches):
        for batch, low, high, data, _, anchor, text, first, count in _chosen(batches, buckets, p):
            keys = _segment_keys(data, first, first + count + p.length - 1)
            bounds = _
            own = batch.column(0).slice(low, high - low).to_numpy()[text]
            ids = batch.column(1).slice(low, high - low).to_numpy()[text]
            columns = [anchor, keys, own, ids, first - bounds[text]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names)

    names = ["anchor", "segment", "row_key", "doc_id", "first"]
    return docs.mapInArrow(run, "anchor long, segment long, row_key long, doc_id long, first long")


def smallest_ids(strings: list[bytes], low: np.ndarray, anchor: np.ndarray, p: Repeats) -> list[np.ndarray]:
    """For each string, the smallest id of each of its windows, over all strings (sorted by anchor).

    Windows that several strings may share are cut out.  Equal cut-outs of one anchor are one, so the sieve is set to the
    differing ones again, for as long as that leaves less; what it leaves over goes to suffix arrays.
    """
    length = p.length
    size = np.array([len(s) for s in strings], np.int64)
    at = np.zeros(len(strings) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    data = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(len(strings)), size)
    position = np.arange(len(data))
    windows = np.flatnonzero(position + length <= at[1:][owner])
    hashes = W.window_hashes(data, windows, length)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    maybe = counts[inverse] > 1
    least = low[owner[windows]].copy()
    picked = windows[maybe]
    if len(picked):
        turn = np.ones(len(picked), bool)
        turn[1:] = (picked[1:] != picked[:-1] + 1) | (owner[picked[1:]] != owner[picked[:-1]])
        begin = np.flatnonzero(turn)
        end = np.append(begin[1:], len(picked))
        raw = data.tobytes()
        cut: dict[tuple[int, bytes], int] = {}  # equal cut-outs of one anchor count once
        which, lows = np.empty(len(begin), np.int64), []
        for k, (x, y) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            s = owner[picked[x]]
            name = (int(anchor[s]), raw[picked[x] : picked[y - 1] + length])
            j = cut.setdefault(name, len(cut))
            if j == len(lows):
                lows.append(int(low[s]))
            lows[j] = min(lows[j], int(low[s]))
            which[k] = j
        if 10 * sum(len(s) for _, s in cut) <= 9 * len(data):
            found = smallest_ids([s for _, s in cut], np.array(lows), np.array([a for a, _ in cut]), p)
        else:
            found = _window_minima(list(cut), np.array(lows), p)
        spots = np.flatnonzero(maybe)
        for k, (x, y) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            least[spots[x:y]] = np.minimum(least[spots[x:y]], found[which[k]])
    return np.split(least, np.searchsorted(windows, at[1:-1]))


def _window_minima(cut: list[tuple[int, bytes]], lows: np.ndarray, p: Repeats) -> list[np.ndarray]:
    """Smallest id of each window of each cut-out string, by one suffix array for some whole anchors."""
    out: list[np.ndarray] = []
    begin = total = 0
    for k, (anchor, string) in enumerate(cut):
        total += len(string) + 1
        if k + 1 == len(cut) or (total >= p.array_bytes and cut[k + 1][0] != anchor):
            out += _by_suffix_array([s for _, s in cut[begin : k + 1]], lows[begin : k + 1], p.length)
            begin, total = k + 1, 0
    return out


def _by_suffix_array(strings: list[bytes], lows: np.ndarray, length: int) -> list[np.ndarray]:
    if len(strings) == 1 and len(strings[0]) == length:
        return [lows.copy()]
    size = np.array([len(s) for s in strings])
    at = np.zeros(len(strings) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    text = np.full(at[-1], 256, np.int64)  # 256 ends every string
    for s, x in zip(strings, at.tolist(), strict=False):
        text[x : x + len(s)] = np.frombuffer(s, np.uint8)
    order = np.array(suffix_array(text.tolist()))
    owner = np.repeat(np.arange(len(strings)), size + 1)
    order = order[order + length <= at[1:][owner[order]] - 1]
    same = np.zeros(max(len(order) - 1, 0), bool)
    step = np.arange(length)
    for x in range(0, len(same), 8192):
        pair = order[x : x + 8193]
        rows = text[pair[:, None] + step]
        same[x : x + len(pair) - 1] = (rows[1:] == rows[:-1]).all(1)
    cuts = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(lows[owner[order]], cuts)
    value = np.empty(at[-1], np.int64)
    value[order] = np.repeat(least, np.diff(np.append(cuts, len(order))))
    return [value[x : x + n - length + 1] for x, n in zip(at.tolist(), size.tolist(), strict=False)]


def _judged(segments: DataFrame, p: Repeats) -> DataFrame:
    """Ranges of windows (begin, end, smallest id) of each segment that some document loses."""

    def run(batches):
        for group in keyed_groups(batches, "part"):
            anchor, key, low, high = (group[c].to_numpy() for c in ("anchor", "segment", "low", "high"))
            order = np.lexsort((key, anchor))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(anchor[order]).astype(bool) | np.diff(key[order]).astype(bool)]))
            low, high = np.minimum.reduceat(low[order], cuts), np.maximum.reduceat(high[order], cuts)
            anchor, key = anchor[order][cuts], key[order][cuts]
            column = group["string"].combine_chunks()
            strings = [column[k].as_py() for k in order[cuts].tolist()]
            rows = {c: [] for c in schema.names}
            for k, least in enumerate(smallest_ids(strings, low, anchor, p)):
                if least.min() < high[k]:
                    edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                    for name, value in zip(schema.names, (anchor[k], key[k], edge, np.append(edge[1:], len(least)), least[edge]), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    lists = pa.list_(pa.int64())
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("begins", lists), ("ends", lists), ("lows", lists)])
    return segments.repartition("part").sortWithinPartitions("part").mapInArrow(
        run, "anchor long, segment long, begins array<long>, ends array<long>, lows array<long>"
    )


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _cut(docs: DataFrame) -> DataFrame:
    """Unite each row's ranges and digest what is left."""

    def run(batches):
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(2))
            rows = {c.split()[0]: [] for c in _RESULT.split(", ")}
            ranges = batch.column(1).to_pylist()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                text = data[bounds[k] : bounds[k + 1]]
                spans = []
                for low, high in sorted((r["low"], r["high"]) for r in ranges[k] or ()):
                    if spans and low <= spans[-1]:
                        spans[-1] = max(spans[-1], high)
                    else:
                        spans += [low, high]
                left, at = hashlib.sha256(), 0
                for low, high in zip(spans[::2], spans[1::2], strict=True):
                    left.update(text[at:low])
                    at = high
                left.update(text[at:])
                removed = sum(spans[1::2]) - sum(spans[::2])
                for name, value in zip(rows, (doc_id, len(text), removed, len(spans) // 2, left.hexdigest(), spans), strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    whole = pa.int64()
    schema = pa.schema([*((c, whole) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("spans", pa.list_(whole))])
    return docs.mapInArrow(run, _RESULT)


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows as a table in buckets of row_key, below the shared folder."""
    name = f"texts_{uuid.uuid4().hex}"
    spark = rows.sparkSession
    rows.write.bucketBy(buckets, "row_key").option("path", work_dir(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", digest))
    short = F.octet_length("text") < p.length
    light = rows.select(
        "row_key", "doc_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(short | F.col("doc_id").isNull(), F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
    )
    light = stage(light, "light")
    firsts = light.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = light.join(firsts, "digest").filter("doc_id > least").select("row_key", "doc_id", "n_bytes", "sha")
    aside = stage(copies.withColumn("gone", F.lit(True)).union(light.filter("doc_id is null").select("row_key", "doc_id", "n_bytes", "sha", F.lit(False))), "copies")
    total = int(light.agg(F.sum("n_bytes")).first()[0] or 0)
    buckets = max(8, 1 + total // p.bucket_bytes)
    main = only_ids(rows, aside.select("row_key").distinct(), "row_key", "left_anti")
    texts = _in_buckets(main.select("row_key", "doc_id", "text"), buckets)

    hashed = max(8, 1 + total // (16 << 20))
    shared = _shared(_marks(texts, hashed, p))
    lists = stage(shared.groupBy("row_key").agg(F.collect_list("anchor").alias("anchors")), "anchors")
    found = int(lists.agg(F.sum(F.size("anchors"))).first()[0] or 0)
    parts = max(8, 1 + found * (p.length + 20) // p.part_bytes)
    marked = texts.join(lists, "row_key").select("row_key", "doc_id", "anchors", "text")
    judged = stage(_judged(_segments(marked, hashed, parts, p), p), "judged")
    spots = _occurrences(marked, hashed, p).join(judged, ["anchor", "segment"])
    spots = spots.select("row_key", "doc_id", "first", F.explode(F.arrays_zip("begins", "ends", "lows")).alias("r")).filter("r.lows < doc_id")
    spans = spots.select("row_key", F.struct((F.col("first") + F.col("r.begins")).alias("low"), (F.col("first") + F.col("r.ends") + (p.length - 1)).alias("high")).alias("span"))
    spans = stage(spans.groupBy("row_key").agg(F.collect_list("span").alias("ranges")), "spans")
    main_rows = _cut(texts.join(spans, "row_key", "left").select("doc_id", "ranges", "text"))
    whole = F.col("gone") & (F.col("n_bytes") >= p.length)
    rest = aside.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.array().cast("array<long>")).alias("spans"),
    )
    return main_rows.unionByName(rest)
