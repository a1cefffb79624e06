"""Helpers that the corpus operators share: staged tables, table scans, Arrow batches, prefix sums."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.staging import Stage, drop_dir, shared_dir, size_of

__all__ = ["KEPT", "Stage", "arrow_rows", "doc_texts", "drop_dir", "free_shuffles", "release", "shared_dir", "size_of", "slices", "staged", "table", "trim"]

#: Rows and bytes of text that a Python worker holds at once while it walks an Arrow batch (a single row may be longer).
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20

#: What modules keep in a worker between tasks, by name: functions that free it and tell whether there was any.
KEPT: dict[str, Callable[[], bool]] = {}


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner find shuffles that nothing refers to, so that their files go before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Spark hands at most so many rows at once to Python: for rows that hold whole sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    return Stage(df, name).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are pruned at the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def trim() -> None:
    """Give memory that is free in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it gives memory back by itself or not at all
        pass


def release(keep: str = "") -> None:
    """Free what other operators have kept in this worker, which Spark uses for one stage after another."""
    if any([free() for name, free in KEPT.items() if name != keep]):
        gc.collect()
        trim()


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Small zero-copy slices of a row at least, so that few Python strings are alive at once.

    keep: what the caller itself keeps in the worker; all else that is kept there goes.
    """
    release(keep)
    for batch in batches:
        ends, at = np.cumsum(_row_bytes(batch)), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            to = min(at + rows, max(at + 1, full), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    trim()
