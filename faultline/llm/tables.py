"""Small helpers that the operators share: Arrow maps, keyed blocks and semi joins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000  # ids that one broadcast may hold (8 MB of longs)
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Cut the Arrow batches of this session by bytes, so long texts need no more memory than short ones.

    A smaller limit that the session has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", str(spark.conf.get(name)).strip().lower()).groups()
    now = int(number) << 10 * " kmgt".index(unit or " ")
    if now <= 0 or now > limit:
        spark.conf.set(name, str(limit))


def binaries(parts: list[np.ndarray]) -> pa.Array:
    """One binary value per array."""
    return pa.array([p.tobytes() for p in parts], pa.binary())


def fixed_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    raw, width = np.ascontiguousarray(matrix).tobytes(), matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int64) * width
    large = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return large.cast(pa.binary())


def keyed_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with an equal key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if held and keys[low] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = keys[low]
    if held:
        yield pa.Table.from_batches(held)


def by_key(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """Apply ``fn`` to every group of rows with an equal long ``key``, many groups to a task."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        rows: list[dict] = []
        for group in keyed_groups(batches, key):
            rows.extend(fn(group))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def only_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi (or anti) join of wide rows with a written table of ids.

    Up to ``limit`` ids (counted first) are broadcast, so the wide rows are not shuffled; more
    ids are joined by a shuffle.
    """
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, column, how)
