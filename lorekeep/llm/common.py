"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.work import materialize, new_path  # noqa: F401

#: A side of a join is hinted for broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000

#: White space as all word rules here define it: space, and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_ROWS; beyond, the planner joins by shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, cut so that the values of a string or binary column are about `limit` bytes a slice."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def release() -> None:
    """Give memory that a task no longer needs back to the system: workers live on, and others share the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def bounded(run: Callable, column: int | None = None) -> Callable:
    """run over slices of its batches (by the bytes of the column), and its memory given back at the end."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches if column is None else slices(batches, column))
        finally:
            release()

    return held


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
