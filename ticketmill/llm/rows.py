"""Helpers shared by the operators: Arrow batches in and out, row keys, shipping the package to the workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticketmill.session import shared_dir, ship_package, stored

#: Rows of one Arrow batch. Texts may be long, so batches stay small; work inside a batch goes by slabs of bytes.
BATCH_ROWS = 1000
SLAB_BYTES = 4 << 20


def prepare_session(spark: SparkSession) -> None:
    """Settings the operators rely on: small Arrow batches, shuffle files removed when their job has ended, and
    this package on every Python worker."""
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    ship_package(spark)


def text_hash() -> Column:
    """64-bit hash of the text. With ``doc_id`` it names a row: rows equal in both are one document repeated."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_by_row(documents: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join ``found`` (doc_id, th, ...) to the rows it is about; its other columns must not clash. The keys of ``found`` go."""
    own, found_id, found_th = (fresh(documents, c) for c in ("own_th", "found_id", "found_th"))
    keyed = documents.withColumn(own, text_hash())
    named = found.withColumnsRenamed({"doc_id": found_id, "th": found_th})
    condition = keyed["doc_id"].eqNullSafe(named[found_id]) & (keyed[own] == named[found_th])
    return keyed.join(named, condition, how).drop(own, found_id, found_th)


_held: dict[str, object] = {}


class Shared:
    """A value of bounded size on every worker, and what a worker makes of it, which stays for its later tasks.

    A worker keeps one such thing at a time, and none while it works for operators that use none.
    """

    def __init__(self, spark: SparkSession, value: object, make: Callable[[object], object] = lambda value: value):
        self.value, self.make, self.key = spark.sparkContext.broadcast(value), make, uuid.uuid4().hex

    def get(self) -> object:
        if self.key not in _held:
            _held.clear()
            _held[self.key] = self.make(self.value.value)
        return _held[self.key]


def tidy() -> None:
    """Give memory that is free in this process back to the system: workers live on and share an executor's room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can do it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, shared: Shared | None = None) -> DataFrame:
    """``mapInArrow`` that leaves nothing behind in the worker but what ``shared`` holds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is None:
            _held.clear()
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(task, schema)


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | StructType, shared: Shared | None = None
) -> DataFrame:
    """``work`` on each Arrow batch; it may return nothing for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = work(batch)
            if out is None or out.num_rows == 0:
                continue
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return map_arrow(df, run, schema, shared)


def extended(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` with further columns after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts end to end, and the offset of each text (one more than texts).

    A null text counts as empty.
    """
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    else:
        wide = np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slabs(sizes: np.ndarray, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Cut consecutive items into runs whose sizes add up to about ``limit``; a larger item is a run of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def store(df: DataFrame, name: str, *partition_by: str, outer: bool = False) -> DataFrame:
    """Write a step's result to the shared folder: it is computed once, and a lost executor loses none of it. Inside ``session.scratch`` the copy
    goes at the end of the block, or, if ``outer``, of the one around it."""
    return stored(df, f"llm-{name}", *partition_by, outer=outer)
