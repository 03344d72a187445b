"""Cutting lineage between stages, and joins with a side of measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

SETTING = "spark.checkpoint.dir"
# Largest side that may be copied to every executor.
MAX_ROWS = 1_000_000
MAX_BYTES = 64 * 1024 * 1024
# Most groups that one task should hold while it aggregates.
TASK_GROUPS = 500_000


def use_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> None:
    """Leaves the cluster's setting alone; ``fallback`` counts only when there is none."""
    if spark.conf.get(SETTING, None) is None and fallback is not None:
        spark.sparkContext.setCheckpointDir(fallback)


def settle(df: DataFrame) -> DataFrame:
    """The same rows, stored once in the shared checkpoint folder.

    Later branches read the stored copy and survive the loss of executors.
    Without a checkpoint folder the plan simply stays lazy.
    """
    spark = df.sparkSession
    if spark.conf.get(SETTING, None) is None and spark.sparkContext.getCheckpointDir() is None:
        return df
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions small rows that are about to expand to many.

    The number of partitions is given, so run-time coalescing, which only sees the
    small rows, leaves it alone; two tables spread on the same keys join in place.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_groups(df: DataFrame, *keys: str, task_groups: int | None = None) -> DataFrame:
    """Spreads rows that are about to be grouped, when most groups have few rows.

    Run-time coalescing makes partitions by bytes, and a task that groups one holds several times as
    much.  Here the number of partitions follows the measured number of groups.  Rows with many to a
    group are returned as they are: partial sums shrink them before they are sent.
    """
    task_groups = task_groups or TASK_GROUPS
    seen = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first()
    rows, groups = seen[0], seen[1]
    if groups <= task_groups or rows >= 4 * groups:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-groups // task_groups)), *keys)


def _width(name: str, kind: DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 8
    return F.lit(8)


def small_side(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Marks ``df`` for broadcast when its measured size is within bounds.

    Tasks send one count and one sum each.  A larger side is returned as it is, so
    that the join shuffles and skewed partitions are split at run time.
    """
    kept = settle(df)
    width = F.lit(0)
    for field in kept.schema.fields:
        width = width + _width(field.name, field.dataType)
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(kept) if rows <= max_rows and size <= max_bytes else kept
