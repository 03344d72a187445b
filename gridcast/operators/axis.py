"""Positions on ordered axes, worked out block by block.

A global ``row_number()`` would sort a whole table in one task.  Here the rows
are cut into blocks that follow the order (a calendar day, a range of names, an id
range); each block is numbered on its own and shifted by the size of the blocks
before it.  The table of block sizes is summed up in the same way once more: runs
of blocks have totals of their own, so no task sees all blocks either; the driver
sees one number per run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from gridcast.functions.times import day_of, epoch_seconds
from gridcast.staging import settle, spread

NAME_BLOCK = 65_536
# Blocks that one task puts in order.
RUN_BLOCKS = 4_096


def _before(keys: Sequence[str], blocks: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)


def run_heads(blocks: DataFrame, order: Sequence[str], run_blocks: int = RUN_BLOCKS) -> list[Row]:
    """First blocks of runs of about ``run_blocks`` along ``order``, at most one for each shuffle partition."""
    place = F.struct(*order)
    count, low = blocks.agg(F.count(F.lit(1)), F.min(place)).first()
    most = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most, -(-count // run_blocks))
    if parts <= 1:
        return [low] if count else []
    ranges = blocks.select(*order).repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("_part"))
    return [low, *sorted((r["_head"] for r in ranges.agg(F.min(place).alias("_head")).collect()), key=_nulls_first)[1:]]


def _nulls_first(head: Row) -> tuple:
    return tuple((v is not None, v) if v is not None else (False,) for v in head)


def run_of(heads: Sequence[Row], order: Sequence[str], blocks: DataFrame) -> Column:
    """Number of the run, from 1, that a block lies in; the heads are literals, so it is the same whenever it is worked out."""
    kinds = [blocks.schema[c].dataType for c in order]
    rows = [F.struct(*[F.lit(v).cast(k).alias(c) for c, v, k in zip(order, head, kinds, strict=True)]) for head in heads]
    return F.size(F.filter(F.array(*rows), lambda head: head <= F.struct(*order)))


def starts_before(blocks: DataFrame, order: Sequence[str], value: str, name: str = "_start", run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """Adds the sum of ``value`` over all blocks before each one; a block is one row, ``order`` tells them apart."""
    blocks = settle(blocks)
    heads = run_heads(blocks, order, run_blocks)
    if not heads:
        return blocks.withColumn(name, F.lit(0).cast("long"))
    placed = blocks.withColumn("_run", run_of(heads, order, blocks))
    offsets = [0]
    if len(heads) > 1:
        totals = {r["_run"]: r["_sum"] for r in placed.groupBy("_run").agg(F.sum(value).alias("_sum")).collect()}
        for run in range(1, len(heads)):
            offsets.append(offsets[-1] + (totals.get(run) or 0))
    inside = F.coalesce(F.sum(value).over(_before(["_run"], order)), F.lit(0))
    earlier = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_run"))
    return placed.withColumn(name, (earlier + inside).cast("long")).drop("_run")


def positions(
    df: DataFrame,
    order: Sequence[str],
    block: dict[str, Column],
    name: str,
    keys: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its ``keys`` group, ordered by ``order``.

    ``block`` maps new column names to expressions that never decrease along
    ``order``; a block should hold a bounded number of rows.  ``total`` names a
    column for the size of the group.
    """
    cuts = list(block)
    tagged = df.withColumns(block)
    sizes = tagged.groupBy(*keys, *cuts).agg(F.count(F.lit(1)).alias("_rows"))
    if keys:
        group_size = [F.sum("_rows").over(Window.partitionBy(*keys)).alias(total)] if total else []
        starts = sizes.select(
            *keys, *cuts, F.coalesce(F.sum("_rows").over(_before(keys, cuts)), F.lit(0)).alias("_start"), *group_size
        )
    else:
        starts = starts_before(sizes, cuts, "_rows").drop("_rows")
        if total:
            starts = starts.withColumn(total, tagged.agg(F.count(F.lit(1))).scalar())
    local = F.row_number().over(Window.partitionBy(*keys, *cuts).orderBy(*order))
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"starts.{c}")) for c in (*keys, *cuts)]
    met = tagged.withColumn("_local", local).alias("rows").join(starts.alias("starts"), same)
    kept = [F.col(f"rows.{c}") for c in df.columns]
    extra = [F.col(f"starts.{total}")] if total else []
    return met.select(*kept, *extra, (F.col("starts._start") + F.col("rows._local") - 1).cast("long").alias(name))


def time_axis(readings: DataFrame, value: str | None = "target") -> DataFrame:
    """Distinct datetimes in order with position ``t``.

    With ``value`` only datetimes that carry a value somewhere count.
    """
    rows = readings if value is None else readings.where(F.col(value).isNotNull())
    distinct = settle(rows.where(F.col("datetime").isNotNull()).select("datetime").distinct())
    return positions(distinct, ["datetime"], {"_day": day_of("datetime")}, "t").select("t", "datetime")


def station_dimension(readings: DataFrame, block_rows: int = NAME_BLOCK) -> DataFrame:
    """``(station, station_id)``: ids follow the order of the names, from 0.

    Names are cut into ranges of about ``block_rows``, at most one for each shuffle partition, wherever they
    differ; the driver sees one name per range.
    """
    names = settle(readings.where(F.col("station").isNotNull()).select("station").distinct())
    heads = run_heads(names, ["station"], block_rows)
    cut = {"_head": run_of(heads, ["station"], names) if heads else F.lit(0)}
    return positions(names, ["station"], cut, "station_id").select(
        "station", F.col("station_id").cast("int").alias("station_id")
    )


def running_total(df: DataFrame, order: str, value: str, name: str, block_rows: int = 65_536) -> DataFrame:
    """Prefix sum of ``value`` along an integer ``order`` column."""
    tagged = df.withColumn("_cut", F.floor(F.col(order) / block_rows))
    starts = starts_before(tagged.groupBy("_cut").agg(F.sum(value).alias("_sum")), ["_cut"], "_sum").drop("_sum")
    local = F.sum(value).over(
        Window.partitionBy("_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tagged.withColumn("_local", local)
        .join(starts, "_cut")
        .withColumn(name, (F.col("_start") + F.col("_local")).cast("long"))
        .drop("_cut", "_local", "_start")
    )


def break_flags(axis: DataFrame, step_seconds: int) -> DataFrame:
    """``is_break`` is 1 where the axis does not advance by exactly one step; 0 at ``t`` 0."""
    earlier = axis.select((F.col("t") + 1).alias("t"), epoch_seconds("datetime").alias("_prev"))
    gap = epoch_seconds("datetime") - F.col("_prev")
    return (
        axis.join(earlier, "t", "left")
        .withColumn("is_break", F.coalesce((gap != step_seconds).cast("int"), F.lit(0)))
        .drop("_prev")
    )


def contiguous_starts(axis: DataFrame, length: int, step_seconds: int, chunk: int = 65_536) -> DataFrame:
    """Positions from which ``length`` axis points follow each other without a break.

    Points with the same number of breaks before them are one stretch; a stretch tells its starts by its
    two ends, and long ones are opened up in chunks.
    """
    counted = running_total(settle(break_flags(axis, step_seconds)), "t", "is_break", "breaks")
    stretches = counted.groupBy("breaks").agg(F.min("t").alias("lo"), (F.max("t") - (length - 1)).alias("hi")).where("lo <= hi")
    chunks = stretches.select("hi", F.explode(F.sequence("lo", "hi", F.lit(chunk).cast("long"))).alias("from"))
    dealt = spread(chunks, "from")
    return dealt.select(F.explode(F.sequence("from", F.least(F.col("from") + (chunk - 1), F.col("hi")))).alias("t"))
