"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paracorpus.session import checkpoint_dir, pin

__all__ = ["broadcast_if_small", "checkpoint_dir", "crc_fold", "giving_back", "pin", "table"]

#: Rows of a narrow side (a few numbers each) that may be sent to every executor.
SMALL_ROWS = 1_000_000


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*(columns or ["*"]))


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else as it is (a shuffle join).

    `df` must be narrow and cheap to count; both ways give the same rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` of a task, after which what it took goes back to the system: the worker stays, for tasks of other stages
    beside a JVM that has grown meanwhile."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return task
