"""Shared storage between steps, joins with a side of measured size, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that is copied to every executor: so many numbers of 8 bytes.
BROADCAST_VALUES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on one machine, a new temporary folder where it is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where and sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        where = sc.getCheckpointDir()
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: lineage ends here and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(settled: DataFrame, values: Column | None = None) -> DataFrame:
    """Marks a settled table for broadcast if it is within bounds; else joins shuffle it.

    ``values``: how many numbers a row holds, where that is not one for each column.
    """
    per_row = F.lit(len(settled.columns)) if values is None else values
    held = settled.agg(F.coalesce(F.sum(per_row), F.lit(0))).first()[0]
    return F.broadcast(settled) if held <= BROADCAST_VALUES else settled


_libc: list[ctypes.CDLL | None] = []


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the system, as it shares an executor with the heap."""
    if not _libc:
        try:
            found = ctypes.CDLL("libc.so.6")
            found.malloc_trim(0)
            _libc.append(found)
        except (OSError, AttributeError):
            # Other C libraries have no such call; memory then goes back as they see fit.
            _libc.append(None)
    pa.default_memory_pool().release_unused()
    if _libc[0] is not None:
        _libc[0].malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of few rows, so that what is built from them stays small; a worker gives back what a task took."""
    # What an earlier task of this worker left in rings goes first.
    gc.collect()
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "2m") -> None:
    """Arrow batches of the session hold at most so many rows and bytes: a batch lies in the executor and in the worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
