"""What the operators of this subpackage share: scratch tables, rows ids and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_BYTES, Scratch, shared_dir, small_side

__all__ = ["BROADCAST_BYTES", "Scratch", "shared_dir", "small_side"]

#: Maximal runs of these are words (everything but ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at the end of a task its memory goes back to the system: workers are kept between tasks, and theirs counts on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library cannot
            ctypes.CDLL(None).malloc_trim(0)

    return whole


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is written inside: texts of thousands of rows at once would fill a worker twice over.

    The session's setting comes back at the end.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that no one holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of one key that a join leaves where they are.
HEAVY = 10_000


def keyed(rows: DataFrame, keys: DataFrame, on: list[str], n: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """rows joined with keys (a stored table, a row per key, n: how many rows have it), inner or left_semi.

    The keys of very many rows are few, so they are broadcast (if their size
    allows) and their rows stay where they are; only the others are dealt by key.
    """
    hot = small_side(keys.where(F.col(n) >= heavy).drop(n))
    few = keys.where(F.col(n) < heavy).drop(n)
    left = rows.join(hot, on, how)
    return left.unionByName(rows.join(hot.select(*on), on, "left_anti").join(few, on, how))


def width_for(df: DataFrame, each: int) -> int:
    """Partitions of about so many bytes, by Spark's estimate of a scan's size; never fewer than the session's shuffle partitions."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # plans that are no scans of files may not be estimated
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // each))


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions for so many rows; never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
