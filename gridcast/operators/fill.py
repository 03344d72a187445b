"""Gap filling on gridded tables.

The nearest readings before and after a row are found inside its (station,
block); what lies beyond the block was put on the block row when the grid was
made.  No task ever holds more than one block of a station, both directions are
plain running frames, and nothing is shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.operators.grid import axis_grid
from gridcast.operators.split import Ranges
from gridcast.staging import small_side


def with_neighbours(
    grid: DataFrame, keys: Sequence[str] = ("station",), value: str = "target"
) -> DataFrame:
    """Adds ``prev`` and ``next``: (t, y) of the closest readings at or around each row.

    The grid must have been made with ``carry=True``.
    """
    reading = F.when(F.col(value).isNotNull(), F.struct(F.col("t").alias("t"), F.col(value).alias("y")))
    upto = Window.partitionBy(*keys, "block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*keys, "block").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.withColumn("prev", F.coalesce(F.last(reading, ignorenulls=True).over(upto), F.col("before")))
        .withColumn("next", F.coalesce(F.last(reading, ignorenulls=True).over(onward), F.col("after")))
        .drop("before", "after")
    )


def _line(t: Column) -> Column:
    p, n = F.col("prev"), F.col("next")
    return p["y"] + (n["y"] - p["y"]) * (t - p["t"]) / (n["t"] - p["t"])


def linear(value: str = "target") -> Column:
    """Straight line between readings; the edges take the nearest reading."""
    p, n = F.col("prev"), F.col("next")
    return (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(p.isNull(), n["y"])
        .when(n.isNull(), p["y"])
        .otherwise(_line(F.col("t")))
    )


def limited(limit: int, value: str = "target") -> Column:
    """As :func:`linear`, but only within ``limit`` steps of a reading on either side."""
    t = F.col("t")
    near = (t - F.col("prev")["t"] <= limit) | (F.col("next")["t"] - t <= limit)
    return F.when(near, linear(value))


def limited_then_carried(limit: int, value: str = "target") -> Column:
    """:func:`limited`, then the last filled value carried forward, then backward.

    The last filled value left of the open middle of a gap sits exactly
    ``limit`` steps after the previous reading, so no second pass is needed.
    """
    p, n = F.col("prev"), F.col("next")
    carried = F.when(p.isNull(), n["y"]).when(n.isNull(), p["y"]).otherwise(_line(p["t"] + limit))
    return F.coalesce(limited(limit, value), carried)


def within_splits(near: DataFrame, ranges: Ranges) -> DataFrame:
    """Forgets neighbours from another split, so that no fill looks across a border."""
    own = F.element_at(F.filter(ranges.array(), lambda r: (r["start"] <= F.col("t")) & (F.col("t") < r["end"])), 1)
    tagged = near.withColumn("_own", own)
    return (
        tagged.withColumn("prev", F.when(F.col("prev")["t"] >= F.col("_own")["start"], F.col("prev")))
        .withColumn("next", F.when(F.col("next")["t"] < F.col("_own")["end"], F.col("next")))
        .drop("_own")
    )


def fill_linear(
    grid: DataFrame,
    keys: Sequence[str] = ("station",),
    value: str = "target",
    default: float | None = None,
    ranges: Ranges | None = None,
) -> DataFrame:
    """Unlimited interpolation by position, with an optional constant for what is left.

    Without ``ranges`` a fill may use readings of a later split; with disjoint
    ``ranges`` every split is filled from its own readings only.
    """
    filled = linear(value) if default is None else F.coalesce(linear(value), F.lit(float(default)))
    near = with_neighbours(grid, keys, value)
    near = near if ranges is None else within_splits(near, ranges)
    return near.withColumn(value, filled).drop("prev", "next")


def fill_columns(
    readings: DataFrame, axis: DataFrame, columns: Sequence[str], default: float | None = None
) -> DataFrame:
    """``(station, t, columns…)``: the target and exogenous columns, each filled on its own.

    Every column becomes a series of its own, so one grid and one fill serve all.
    """
    apart = readings.unpivot(["station", "datetime"], list(columns), "variable", "target")
    keys = ["station", "variable"]
    filled = fill_linear(axis_grid(apart, axis, keys, carry=True), keys, default=default)
    return filled.groupBy("station", "t").pivot("variable", list(columns)).agg(F.first("target"))


def fill_limited(grid: DataFrame, limit: int, keys: Sequence[str] = ("station",), value: str = "target") -> DataFrame:
    """Limited interpolation only; long gaps stay open in the middle."""
    return with_neighbours(grid, keys, value).withColumn(value, limited(limit, value)).drop("prev", "next")


def fill_clean(grid: DataFrame, limit: int, keys: Sequence[str] = ("station",), value: str = "target") -> DataFrame:
    """The curation fill: limited interpolation, carry forward, carry backward."""
    return (
        with_neighbours(grid, keys, value)
        .withColumn(value, limited_then_carried(limit, value))
        .drop("prev", "next")
    )


INNER_PIECES = 4096


def station_medians(df: DataFrame, keys: Sequence[str] = ("station",), value: str = "target") -> DataFrame:
    """Exact median per station without gathering a station's values anywhere.

    Equal values are counted first.  A logarithmic value range cuts every station
    into ordered pieces; piece totals say which pieces hold the middle.  Those are
    cut again between their own limits, as all values may lie in one narrow band,
    and only the inner pieces that hold the middle are ranked.
    """
    keys = list(keys)
    v = F.col(value)
    piece = (F.signum(v) * F.floor(F.log1p(F.abs(v)) * 256)).cast("long")
    counts = (
        df.where(v.isNotNull())
        .groupBy(*keys, v.alias("_v"), piece.alias("_piece"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    sums = counts.groupBy(*keys, "_piece").agg(F.sum("_n").alias("_sum"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    located = (
        sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_sum").over(whole))
        .withColumn("_lo", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2) + 1)
        .where((F.col("_start") < F.col("_hi")) & (F.col("_start") + F.col("_sum") >= F.col("_lo")))
    )
    share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    inner = F.when(F.col("_high") > F.col("_low"), F.floor(share * INNER_PIECES)).otherwise(F.lit(0)).cast("long")
    inside = counts.join(located.drop("_sum"), [*keys, "_piece"]).withColumn("_inner", inner)
    ranges = inside.groupBy(*keys, "_piece", "_inner", "_start", "_lo", "_hi").agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy(*keys, "_piece").orderBy("_inner").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_begin", F.col("_start") + F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).where(
        (F.col("_begin") < F.col("_hi")) & (F.col("_begin") + F.col("_sum") >= F.col("_lo"))
    )
    ranked_in = [*keys, "_piece", "_inner"]
    running = Window.partitionBy(*ranked_in).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.join(ranges.select(*ranked_in, "_begin"), ranked_in).withColumn(
        "_upto", F.col("_begin") + F.sum("_n").over(running)
    )

    def at(rank: str) -> Column:
        inside = (F.col("_upto") >= F.col(rank)) & (F.col("_upto") - F.col("_n") < F.col(rank))
        return F.max(F.when(inside, F.col("_v")))

    return ranked.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias("median"))


def fill_with_median(df: DataFrame, keys: Sequence[str] = ("station",), value: str = "target") -> DataFrame:
    """NULLs take the station's median; a station without any value takes 0."""
    medians = station_medians(df, keys, value).withColumnRenamed("median", "_median")
    return (
        df.join(small_side(medians), list(keys), "left")
        .withColumn(value, F.coalesce(value, "_median", F.lit(0.0)))
        .drop("_median")
    )
