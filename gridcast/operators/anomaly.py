"""Point adjustment of anomaly flags.

A true run counts as found when any of its points was flagged; then all of its
points are.  The sequence is cut into blocks of the order column.  Runs inside
a block are settled there; only the first and the last run of a block can reach
further, and these are settled on a table of two rows per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.staging import settle


def point_adjust(
    flags: DataFrame,
    order: str,
    truth: str = "gt",
    found: str = "pred",
    block_rows: int = 65_536,
    skip_first: bool = False,
) -> DataFrame:
    """Adds ``adjusted``.

    ``order`` is an integer column.  With ``skip_first`` the very first row is
    only set by its own flag, never by a later one of its run.
    """
    cut = flags.withColumn("_b", F.floor(F.col(order) / block_rows))
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = cut.withColumn("_z", F.sum(1 - F.col(truth)).over(within))
    hit = F.when(F.col(truth) == 1, F.col(found))
    # One row per (block, run), partial sums first; then two rows per block.
    run_rows = runs.groupBy("_b", "_z").agg(F.max(hit).alias("_hit"))
    edges = run_rows.groupBy("_b").agg(
        F.max("_z").alias("_zeros"),
        F.max(F.when(F.col("_z") == 0, F.col("_hit"))).alias("_head"),
        F.max_by("_hit", "_z").alias("_tail"),
    )
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    based = settle(edges.withColumn("_base", F.coalesce(F.sum("_zeros").over(before), F.lit(0))))
    # The first and the last run of every block, under the number of the whole run.
    first = F.struct(F.col("_base").alias("run"), F.col("_head").alias("hit"), F.lit(True).alias("is_first"))
    last = F.struct((F.col("_base") + F.col("_zeros")).alias("run"), F.col("_tail").alias("hit"), F.lit(False).alias("is_first"))
    ends = based.select("_b", "_zeros", F.explode(F.array(first, last)).alias("_end"))
    whole = F.max("_end.hit").over(Window.partitionBy("_end.run"))
    carried = (
        ends.withColumn("_whole", whole)
        .groupBy("_b", "_zeros")
        .agg(
            F.max(F.when(F.col("_end.is_first"), F.col("_whole"))).alias("_from_head"),
            F.max(F.when(~F.col("_end.is_first"), F.col("_whole"))).alias("_from_tail"),
        )
    )
    own = F.max(hit).over(Window.partitionBy("_b", "_z"))
    out = runs.withColumn("_own", own).join(carried, "_b")
    reach = F.greatest(
        F.col("_own"),
        F.when(F.col("_z") == 0, F.col("_from_head")),
        F.when(F.col("_z") == F.col("_zeros"), F.col("_from_tail")),
    )
    adjusted = F.when(F.col(truth) == 1, F.coalesce(reach, F.col(found))).otherwise(F.col(found))
    if skip_first:
        out = out.withColumn("_first", flags.agg(F.min(order)).scalar())
        adjusted = F.when(F.col(order) == F.col("_first"), F.col(found)).otherwise(adjusted)
    return out.withColumn("adjusted", adjusted.cast("int")).select(*flags.columns, "adjusted")


def accuracy(labels: DataFrame, truth: str, found: str) -> DataFrame:
    return labels.agg(F.avg((F.col(truth) == F.col(found)).cast("double")).alias("accuracy"))
