"""Shards by best-fit-decreasing bin packing of indivisible groups (rows of equal text).

Groups, largest first, enter the bin with the least room that still holds them; the open bins lie
in a balanced tree ordered by room.  Packing goes over two levels so that no task sees all groups:
lots of groups are packed into small trays in parallel, then the trays, whose number depends on
the number of shards only (and one open tray a lot), are packed into the shards.

For a given number of shards the capacity is the smallest at which best fit needs no further shard, found by
bisection, so sizes come out near equal.  A group above a fair share gets a shard of its own and the rest is
shared by the others.  ``pack_to_capacity`` takes the capacity instead and opens as few shards as best fit needs.

Defined results: null text has no bytes and is one group with other null texts; equal rows keep a slot each.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from faultline.session import stage


@dataclass(frozen=True)
class Shards:
    count: int = 8
    trays: int = 512  # per shard
    lot_groups: int = 100_000
    piece_rows: int = 1 << 17  # rows that are numbered together


class Rooms:
    """Open bins ordered by (room, bin): a two-level balanced tree whose leaves split when full."""

    LEAF = 256

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = [(-1, -1)]  # smallest entry that may lie in each leaf

    def add(self, room: int, number: int) -> None:
        k = max(0, bisect_left(self.tops, (room, number + 1)) - 1)
        leaf = self.leaves[k]
        insort(leaf, (room, number))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves.insert(k + 1, leaf[half:])
            self.tops.insert(k + 1, leaf[half])
            del leaf[half:]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of at least ``size``."""
        k = max(0, bisect_left(self.tops, (size, 0)) - 1)
        while k < len(self.leaves):
            leaf = self.leaves[k]
            at = bisect_left(leaf, (size, -1))
            if at < len(leaf):
                found = leaf.pop(at)
                if not leaf and k:
                    del self.leaves[k], self.tops[k]
                return found
            k += 1
        return None


def best_fit_decreasing(sizes: np.ndarray, capacity: int, most: int | None = None) -> np.ndarray | None:
    """Bin of each size; larger ones than the capacity stand alone.  None if more than ``most`` bins are needed."""
    out = np.empty(len(sizes), np.int64)
    rooms, opened = Rooms(), 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = rooms.take(size) if size <= capacity else None
        if found is None:
            if opened == most:
                return None
            found, opened = (capacity, opened), opened + 1
        out[k] = found[1]
        if found[0] > size:
            rooms.add(found[0] - size, found[1])
    return out


def pack_into(sizes: np.ndarray, count: int) -> np.ndarray:
    """Bins 0..count-1 of near equal sizes."""
    out = np.empty(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    alone, total = 0, int(sizes.sum())
    while alone < min(count - 1, len(order)) and int(sizes[order[alone]]) * (count - alone) > total:
        total -= int(sizes[order[alone]])
        out[order[alone]] = alone
        alone += 1
    rest, bins = order[alone:], count - alone
    if not len(rest):
        return out
    low = max(-(-total // bins), int(sizes[rest[0]]))
    high, best = low, None
    while best is None:
        best = best_fit_decreasing(sizes[rest], high, bins)
        low, high = (low, high) if best is not None else (high + 1, high + max(1, high // 64))
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes[rest], middle, bins)
        low, high, best = (low, middle, tried) if tried is not None else (middle + 1, high, best)
    out[rest] = alone + best
    return out


def _packed(frame: pd.DataFrame, bins: np.ndarray, name: str) -> pd.DataFrame:
    return frame.assign(**{name: bins.astype(np.int64)})


def shard_groups(groups: DataFrame, p: Shards = Shards()) -> DataFrame:
    """(group_key, shard) for groups (group_key, weight)."""
    held = groups.agg(F.count("*"), F.sum("weight")).first()
    total, lots = int(held[1] or 0), 1 + int(held[0]) // p.lot_groups
    tray = max(1, total // (p.count * p.trays))
    lotted = groups.withColumn("lot", F.pmod(F.xxhash64("group_key", F.lit(3)), F.lit(lots)).cast("int"))

    def fill(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values("group_key", ignore_index=True)
        return _packed(lot, best_fit_decreasing(lot["weight"].to_numpy(), tray), "tray")

    trays = stage(lotted.groupBy("lot").applyInPandas(fill, "group_key binary, weight long, lot int, tray long"), "trays")

    def deal(all_trays: pd.DataFrame) -> pd.DataFrame:
        all_trays = all_trays.sort_values(["lot", "tray"], ignore_index=True)
        return _packed(all_trays, pack_into(all_trays["weight"].to_numpy(), p.count), "shard")

    sums = trays.groupBy("lot", "tray").agg(F.sum("weight").alias("weight")).withColumn("one", F.lit(0))
    shards = sums.groupBy("one").applyInPandas(deal, "lot int, tray long, weight long, one int, shard long")
    return trays.join(stage(shards.select("lot", "tray", F.col("shard").cast("int").alias("shard")), "shards"), ["lot", "tray"]).select("group_key", "shard")


def pack_to_capacity(groups: DataFrame, capacity: int, lot_shards: int = 64) -> DataFrame:
    """(group_key, shard) with as few shards of the given capacity as best fit needs.

    Lots of about ``lot_shards`` capacities are packed side by side, so at most one shard a lot stays
    half full.  A group above the capacity has a shard of its own.
    """
    total = int(groups.agg(F.sum("weight")).first()[0] or 0)
    lots = 1 + total // (capacity * lot_shards)
    lotted = groups.withColumn("lot", F.pmod(F.xxhash64("group_key", F.lit(3)), F.lit(lots)).cast("int"))

    def fill(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values("group_key", ignore_index=True)
        return _packed(lot, best_fit_decreasing(lot["weight"].to_numpy(), capacity), "tray")

    packed = stage(lotted.groupBy("lot").applyInPandas(fill, "group_key binary, weight long, lot int, tray long"), "packed")
    counts = packed.groupBy("lot").agg((F.max("tray") + 1).alias("n"))
    before = Win.partitionBy(F.lit(0)).orderBy("lot").rowsBetween(Win.unboundedPreceding, -1)
    starts = counts.select("lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return packed.join(starts, "lot").select("group_key", (F.col("start") + F.col("tray")).alias("shard"))


def numbered(rows: DataFrame, p: Shards) -> DataFrame:
    """Add ``slot``: a gapless number from 0 within each shard, without bringing a shard together."""
    pieces = 1 + rows.count() // (p.count * p.piece_rows)
    piece = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(5)), F.lit(max(pieces, 8))).cast("int")
    rows = rows.withColumn("piece", piece)
    before = Win.partitionBy("shard").orderBy("piece").rowsBetween(Win.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "piece").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Win.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("spot", F.row_number().over(own)).join(starts, ["shard", "piece"])
    return rows.withColumn("slot", F.col("start") + F.col("spot") - 1).drop("piece", "start", "spot")


def shard_documents(docs: DataFrame, p: Shards = Shards(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) of every row."""
    text = F.col(text_col)
    light = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.unhex(F.coalesce(F.md5(text.cast("binary")), F.lit("00"))).alias("group_key"),
        ),
        "light",
    )
    groups = stage(light.groupBy("group_key").agg(F.sum("size").alias("weight")), "groups")
    placed = stage(light.join(shard_groups(groups, p), "group_key").drop("group_key"), "placed")
    return numbered(placed, p).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
