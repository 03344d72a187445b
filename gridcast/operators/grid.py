"""Regular and global grids: every station gets every axis position.

The grid is made from (station, block) rows: those small rows are shuffled, then
each one expands to the positions of its block.  Grid rows themselves are never
shuffled and no cross join is needed; a single long station still spreads over
as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.functions.times import NAIVE, epoch_seconds, seconds_interval
from gridcast.staging import small_side, spread

BLOCK_ROWS = 4096
EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Extent:
    """First and last datetime of a table: one row, whatever the table holds."""

    first: datetime | None
    last: datetime | None

    def steps(self, step_seconds: int) -> int:
        """Number of grid positions from the first to the last datetime."""
        if self.first is None or self.last is None:
            return 0
        return (self.last - self.first) // timedelta(seconds=step_seconds) + 1

    def phase(self, step_seconds: int) -> int:
        """Distance of the grid from whole steps since 1970, in seconds."""
        return ((self.first or EPOCH) - EPOCH) // timedelta(seconds=1) % step_seconds

    def days(self) -> int:
        """Number of calendar days touched."""
        return self.steps(86_400) + 1


def block_of(t: Column | str, block_rows: int = BLOCK_ROWS) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / block_rows).cast("long")


def _block_in(t: Column, first: int, n_steps: int, block_rows: int) -> Column:
    """Block of a position counted from ``first``; all before it are in block -1, all after the last in the one that follows."""
    after = (n_steps - 1) // block_rows + 1
    inside = block_of(t - first, block_rows)
    return F.when(t < first, F.lit(-1)).when(t >= first + n_steps, F.lit(after)).otherwise(inside).cast("long")


def mean_duplicates(readings: DataFrame, keys: Sequence[str] = ("station", "datetime"), value: str = "target") -> DataFrame:
    """One row per key: the mean of its non-null values, NULL when it has none."""
    return readings.groupBy(*keys).agg(F.avg(value).alias(value))


def extent(readings: DataFrame) -> DataFrame:
    """First and last datetime of the whole table."""
    return readings.agg(F.min("datetime").alias("first_datetime"), F.max("datetime").alias("last_datetime"))


def extent_of(readings: DataFrame) -> Extent:
    return Extent(*extent(readings).first())


def regular_axis(spark: SparkSession, limits: Extent, step_seconds: int) -> DataFrame:
    """``(t, datetime)`` of every step, made in parallel."""
    steps = spark.range(limits.steps(step_seconds)).withColumnRenamed("id", "t")
    when = F.lit(limits.first or EPOCH).cast(NAIVE) + seconds_interval(F.col("t") * step_seconds)
    return steps.withColumn("datetime", when)


def axis_length(axis: DataFrame) -> int:
    """Number of axis positions."""
    return axis.count()


def _blocks(stations: DataFrame, placed: DataFrame, keys: Sequence[str], n_steps: int, block_rows: int, value: str | None) -> DataFrame:
    """One row per (station, block); with ``value`` also the closest readings outside the block.

    With ``value`` there is also a block before the first and one after the last, for readings outside the
    positions wanted: they only pass on what they carry and expand to nothing.
    """
    last_block = (n_steps - 1) // block_rows
    low, high = (0, last_block) if value is None else (-1, last_block + 1)
    numbers = F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")) if n_steps else F.array().cast("array<long>")
    blocks = stations.select("*", F.explode(numbers).alias("block"))
    if value is None:
        return spread(blocks, *keys, "block")
    reading = F.when(F.col(value).isNotNull(), F.struct(F.col("t").alias("t"), F.col(value).alias("y")))
    edges = placed.groupBy(*keys, "block").agg(F.min(reading).alias("_first"), F.max(reading).alias("_last"))
    past = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.join(edges, [*keys, "block"], "left")
        .withColumn("before", F.last("_last", ignorenulls=True).over(past))
        .withColumn("after", F.last("_first", ignorenulls=True).over(future))
        .drop("_first", "_last")
    )
    return spread(carried, *keys, "block")


def _expand(
    blocks: DataFrame, placed: DataFrame, keys: Sequence[str], n_steps: int, block_rows: int, value: str, first: int = 0
) -> DataFrame:
    """All positions of every block, with the value of those that have a reading.

    Both sides lie by station and block, and that is all they are joined on: a join on the position
    as well would make Spark shuffle every grid row.  The readings of a block travel as one array.
    """
    low = F.col("block") * block_rows + first
    end = F.least(low + block_rows, F.lit(first + n_steps).cast("long"))
    # Not a filter: it would be pushed below the shuffle, which then ran once for the carried readings and once for these.
    wanted = (F.col("block") >= 0) & (low < first + n_steps)
    point = F.when(wanted, F.struct(F.col("t").alias("t"), F.col(value).alias("y")))
    points = placed.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(point)).alias("_points"))

    def gap(size: Column) -> Column:
        return F.array_repeat(F.lit(None).cast(placed.schema[value].dataType), size.cast("int"))

    p = F.col("_points")
    following = lambda i: F.coalesce(F.get(p, i + 1)["t"], end)
    runs = F.transform(p, lambda x, i: F.concat(F.array(x["y"]), gap(following(i) - x["t"] - 1)))
    values = F.when(~wanted, gap(F.lit(0))).when(p.isNull(), gap(end - low)).otherwise(F.concat(gap(F.get(p, F.lit(0))["t"] - low), F.flatten(runs)))
    joined = blocks.join(points, [*keys, "block"], "left")
    return joined.select(*blocks.columns, F.posexplode(values).alias("_i", value)).withColumn("t", low + F.col("_i")).drop("_i")


def on_grid(readings: DataFrame, limits: Extent, step_seconds: int) -> DataFrame:
    """Readings that fall on the grid, with their distance ``_off`` from its start in seconds."""
    origin = ((limits.first or EPOCH) - EPOCH) // timedelta(seconds=1)
    placed = readings.where(F.col("datetime").isNotNull()).withColumn("_off", epoch_seconds("datetime") - F.lit(origin))
    return placed.where(F.pmod("_off", F.lit(step_seconds)) == 0)


def regular_grid(
    readings: DataFrame,
    step_seconds: int,
    keys: Sequence[str] = ("station",),
    value: str = "target",
    block_rows: int = BLOCK_ROWS,
    limits: Extent | None = None,
    carry: bool = False,
    stations: DataFrame | None = None,
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """All steps between the first and last datetime, for every station.

    Duplicates are averaged; readings off the step are not on the grid.
    ``stations`` lists the stations wanted, one row each; its other columns are
    kept on every grid row, and readings of other stations are left out.
    ``carry`` adds ``before`` and ``after``, the closest readings outside each
    row's block, which the fills need; they are worked out on block rows.
    ``span`` gives the positions wanted, from the first up to before the last: only those become rows, in
    blocks counted from the first, and ``carry`` still knows the readings around them.
    """
    limits = extent_of(readings) if limits is None else limits
    first, end = (0, limits.steps(step_seconds)) if span is None else (max(span[0], 0), min(span[1], limits.steps(step_seconds)))
    n_steps = max(end - first, 0)
    start = limits.first or EPOCH
    placed = (
        on_grid(readings, limits, step_seconds)
        .select(*keys, value, "_off")
        .groupBy(*keys, F.floor(F.col("_off") / step_seconds).cast("long").alias("t"))
        .agg(F.avg(value).alias(value))
        .withColumn("block", _block_in(F.col("t"), first, n_steps, block_rows))
    )
    placed = spread(placed, *keys, "block")
    if stations is None:
        stations = readings.where(F.col("datetime").isNotNull()).select(*keys).distinct()
    blocks = _blocks(stations, placed, keys, n_steps, block_rows, value if carry else None)
    when = F.lit(start).cast(NAIVE) + seconds_interval(F.col("t") * step_seconds)
    extra = [c for c in blocks.columns if c not in (*keys, "block")]
    return _expand(blocks, placed, keys, n_steps, block_rows, value, first).select(
        *keys, "block", "t", when.alias("datetime"), value, *extra
    )


def axis_grid(
    readings: DataFrame,
    axis: DataFrame,
    keys: Sequence[str] = ("station",),
    value: str = "target",
    block_rows: int = BLOCK_ROWS,
    n_steps: int | None = None,
    carry: bool = False,
) -> DataFrame:
    """Every station on every position of a given (possibly irregular) axis."""
    n_steps = axis_length(axis) if n_steps is None else n_steps
    placed = (
        readings.groupBy(*keys, "datetime")
        .agg(F.avg(value).alias(value))
        .join(small_side(axis), "datetime")
        .select(*keys, block_of("t", block_rows).alias("block"), "t", value)
    )
    placed = spread(placed, *keys, "block")
    stations = readings.select(*keys).distinct()
    blocks = _blocks(stations, placed, keys, n_steps, block_rows, value if carry else None)
    extra = [c for c in blocks.columns if c not in (*keys, "block")]
    return _expand(blocks, placed, keys, n_steps, block_rows, value).select(*keys, "block", "t", value, *extra)


def flag_missing(grid: DataFrame, value: str = "target") -> DataFrame:
    """``miss_target``: 1 where the value is missing; take it before any fill."""
    return grid.withColumn("miss_target", F.col(value).isNull().cast("tinyint"))


def incomplete_stations(grid: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Stations whose row count differs from the number of datetimes still in the table."""
    expected = grid.agg(F.countDistinct("datetime")).scalar()
    counts = grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("expected", expected).where(F.col("rows") != F.col("expected"))
