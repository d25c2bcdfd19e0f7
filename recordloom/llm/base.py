"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are compared: it is the largest.
NULL_ID = 2**63 - 1
#: Bytes of text that one step of a task works on at a time; longer single texts go alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What workers hold beyond a task, as functions that let it go.
HELD: list[Callable[[], None]] = []


def free_memory() -> None:
    """Give back what earlier tasks of another operator left in this worker."""
    for release in HELD:
        release()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):   # the C library of Linux keeps freed pages otherwise
        ctypes.CDLL(None).malloc_trim(0)


def id_key(name: str) -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of one string column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(size.astype(np.int64))))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def in_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str):
    """A function for mapInArrow that applies `fn` to bounded slices of its batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for part in sliced(batches, column):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out
    return run


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every entry of a list<long> column; null lists have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), flat.astype(np.int64, copy=False)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value evaluated once per row, whatever the optimiser merges."""
    return F.element_at(F.transform(F.array(value), body), 1)
