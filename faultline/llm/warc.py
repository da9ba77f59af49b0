"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, and a footer in a
skippable frame: the seek table of compressed and plain sizes.  The index maps each record identifier to its
bundle, frame, and offset and length inside the plain frame.  Frames are read back one by one,
so a scan is split by frames and a lookup decodes only the frames it needs.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a response,
the others are revisits of it.  Payloads are shuffled once, by page; which one is the response is
found on digests alone.  A bundle is written under a name of its own and then renamed, so a repeated task
replaces it by the same bytes.

Defined results: null html is an empty payload; a null page_id counts as smaller than any other; of
rows that repeat a page_id and payload the first by url is the response if that id is the largest, the
rest revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import stage, work_dir

from .tables import bounded_batches

# fixed values: the seekable format's magic numbers, and header texts of the archive format
SEEK_FRAME = 0x184D2A5E
SEEK_END = 0x8F92EAB1
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    min_bytes: int = 0
    frame_bytes: int = 1 << 20
    bundle_bytes: int = 32 << 20  # of payloads
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"  # of every record; pages carry no date


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "/", path)))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(number: str, url: str | None, payload: bytes, refers_to: str | None, a: Archive) -> bytes:
    """One WARC record: an HTTP response with its payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{number}>", f"WARC-Date: {a.date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block, and where the next record begins."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"no record at {at}")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    begin = stop + 4
    end = begin + int(head["content-length"])
    return head, data[begin:end], end + 4


class Bundle:
    """Writes records into frames and the seek table behind them."""

    def __init__(self, out, a: Archive):
        self.out, self.a, self.table = out, a, []
        self.frame, self.size = [], 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in the plain frame and length of the record."""
        if self.size and self.size + len(data) > self.a.frame_bytes:
            self.flush()
        spot = (len(self.table), self.size, len(data))
        self.frame.append(data)
        self.size += len(data)
        return spot

    def flush(self) -> None:
        if self.size:
            packed = zstandard.ZstdCompressor(level=self.a.level).compress(b"".join(self.frame))
            self.out.write(packed)
            self.table.append((len(packed), self.size))
            self.frame, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of each frame, from a bundle's footer."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_END:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - width * count)
    raw, at, out = file.read(width * count), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", raw, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long, record_type string"


def write_archives(pages: DataFrame, folder: str, a: Archive = Archive()) -> DataFrame:
    """Write the bundles below ``folder``; returns the written index."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("row_key", F.xxhash64("page_id", "sha"))
    light = stage(pages.select("page_id", "sha", "row_key", F.octet_length("html").alias("size")), "digests")
    best = light.groupBy("sha").agg(F.max("page_id").alias("best"))
    found = light.filter(F.col("size") >= a.min_bytes).select("row_key", "sha").dropDuplicates(["row_key"]).join(best, "sha")
    total = int(light.agg(F.sum(F.col("size") + 512)).first()[0] or 0)
    bundles = 1 + total // a.bundle_bytes
    # the join keeps this layout, so equal rows meet in one bundle and payloads move once
    spread = pages.repartition(bundles, "row_key").join(found.select("row_key", "best", F.lit(True).alias("grouped")), "row_key", "left")
    rows = spread.sortWithinPartitions("page_id", "sha", "url").select("page_id", "url", "html", "sha", "best", "grouped")

    bounded_batches(pages.sparkSession)
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _open(folder)
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.zst"
        own = f"{base}/.{name}.{uuid.uuid4().hex}"
        index: dict[str, list] = {x.split()[0]: [] for x in INDEX.split(", ")}
        bundle, last, copy = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                bundle = bundle or Bundle(fs.open_output_stream(own), a)
                page, sha = row["page_id"], row["sha"]
                copy = copy + 1 if last == (page, sha) else 0
                last = (page, sha)
                number = ("" if page is None else str(page)) + (f":{copy}" if copy else "")
                first = not row["grouped"] or (page == row["best"] and not copy)
                target = None if first else "" if row["best"] is None else str(row["best"])
                spot = bundle.add(record(number, row["url"], row["html"].encode(), target, a))
                values = (page, f"<urn:page:{number}>", name, *spot, "response" if first else "revisit")
                for column, value in zip(index.values(), values, strict=True):
                    column.append(value)
        if bundle is not None:
            bundle.close()
            bundle.out.close()
            fs.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict(index, schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in INDEX.split(", "))])
    return stage(rows.mapInArrow(run, INDEX), "index")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, frame, at, packed, plain) of every frame below ``folder``, from the footers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                fs, local = _open(path)
                with fs.open_input_file(local) as file:
                    rows += [{"bundle": path, "frame": k, "at": at, "packed": packed, "plain": plain} for k, (at, packed, plain) in enumerate(seek_table(file))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("packed", pa.int64()), ("plain", pa.int64())])
    return files.mapInArrow(run, "bundle string, frame int, at long, packed long, plain long")


RECORD = "page_id long, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"


def _row(head: dict[str, str], block: bytes) -> dict:
    """A record's fields; a response's payload is held against its digest."""
    page = re.fullmatch(r"<urn:page:(-?\d*)(?::\d+)?>", head["warc-record-id"])[1]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    response = head["warc-type"] == "response"
    if response and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged payload in {head['warc-record-id']}")
    target = re.fullmatch(r"<urn:page:(-?\d*)>", head.get("warc-refers-to", "<urn:page:>"))[1]
    return {
        "page_id": int(page) if page else None, "record_id": head["warc-record-id"], "record_type": head["warc-type"], "refers_to": int(target) if target else None,
        "payload_bytes": size, "payload_digest": digest, "url": head.get("warc-target-uri"), "payload": payload if response else None,
    }


_RECORD_SCHEMA = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in RECORD.split(", "))])


def _tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for rows that are small themselves but stand for much work: all cores are used, and no task has too many."""
    return max(1, min(rows, 2 * spark.sparkContext.defaultParallelism), rows // per_task)


def read_archives(spark: SparkSession, folder: str, frames_per_task: int = 64) -> DataFrame:
    """Every record of every bundle; frames are dealt out one by one, by their counted number."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = _open(row["bundle"])
                with fs.open_input_file(local) as file:
                    file.seek(row["at"])
                    plain = zstandard.ZstdDecompressor().decompress(file.read(row["packed"]), max_output_size=row["plain"])
                at, rows = 0, []
                while at < len(plain):
                    head, block, at = parse(plain, at)
                    rows.append(_row(head, block))
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)

    listed = stage(frames(spark, folder), "frames")
    return listed.repartition(_tasks(spark, listed.count(), frames_per_task), "bundle", "frame").mapInArrow(run, RECORD)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records of some index rows, decoding only the frames that hold them."""
    name = F.element_at(F.split("path", "/"), -1)
    places = frames(spark, folder).withColumnRenamed("bundle", "path").withColumn("bundle", name)
    rows = wanted.select("bundle", "frame", "offset").join(places, ["bundle", "frame"])
    rows = stage(rows, "wanted")
    rows = rows.repartition(_tasks(spark, rows.count(), 4096), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches):
        held, plain = None, b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held != (row["path"], row["frame"]):
                    fs, local = _open(row["path"])
                    with fs.open_input_file(local) as file:
                        file.seek(row["at"])
                        plain = zstandard.ZstdDecompressor().decompress(file.read(row["packed"]), max_output_size=row["plain"])
                    held = (row["path"], row["frame"])
                out.append(_row(*parse(plain, row["offset"])[:2]))
            yield pa.RecordBatch.from_pylist(out, schema=_RECORD_SCHEMA)

    return rows.mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame, a: Archive = Archive()) -> DataFrame:
    """Write all pages into bundles in the shared folder and return the records as read back."""
    folder = work_dir(pages.sparkSession, "warc")
    write_archives(pages, folder, a)
    return read_archives(pages.sparkSession, folder)
