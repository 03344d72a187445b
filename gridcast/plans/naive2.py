"""The seasonal benchmark forecast: test of seasonality, classical decomposition, last deseasonalised value.

Series come in long form ``(series, t, y, n)`` and are held as blocks with one season of points from
behind, so lags and moving averages are taken inside a block and only sums leave it, whatever the
length of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.operators.ragged import KEY
from gridcast.operators.windows import BLOCK_POINTS, series_blocks

# Normal quantile of the 90 % test, and the least number of seasons that is tested.
LEVEL, SEASONS = 1.645, 3


def insample(points: DataFrame, horizon: int) -> DataFrame:
    """All but the last ``horizon`` points of each series, with the shorter length; series without such points go."""
    return points.select(KEY, "t", "y", (F.col("n") - horizon).alias("n")).where("t < n")


def seasonal_scales(points: DataFrame, season: int) -> DataFrame:
    """``(series, scale)``: mean absolute change over one season; null for series of no more than a season."""
    rows = _spans(points, season)
    return rows.groupBy(KEY).agg(F.avg(F.abs(F.get("w", F.lit(season)) - F.get("w", F.lit(0)))).alias("scale"))


def _spans(points: DataFrame, season: int) -> DataFrame:
    """One row for each point with itself and the ``season`` points behind it, as far as there are any."""
    blocks = series_blocks(points, season, [KEY, "n"], value="y", block_points=BLOCK_POINTS)
    own = F.least(F.lit(BLOCK_POINTS).cast("long"), F.col("n") - F.col("base"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), own - 1)).alias("i")
    opened = blocks.select(KEY, "n", "base", "points", at)
    span = F.slice("points", (F.col("i") + 1).cast("int"), F.lit(season + 1))
    return opened.select(KEY, "n", (F.col("base") + F.col("i")).alias("t"), span.alias("w"))


def _ratio(season: int) -> Column:
    """A point over the moving average centred on it; null where the average would reach beyond the series."""
    half = season // 2
    width = season + 1 if season % 2 == 0 else season
    edge = 0.5 if season % 2 == 0 else 1.0
    total = F.lit(0.0)
    for k in range(width):
        total = total + F.get("w", F.lit(k)) * (edge if k in (0, width - 1) else 1.0)
    return F.try_divide(F.get("w", F.lit(half)), total / season)


def seasonal_profile(points: DataFrame, season: int) -> DataFrame:
    """``(series, n, last, seasonal, indices)``: indices average 1, one for each place in the season.

    A series is seasonal if it is positive throughout, has three seasons at least, and its correlation with
    itself one season ago is beyond the limit that the shorter lags set.  Constant series are not.
    """
    rows = _spans(points, season)
    means = points.groupBy(KEY).agg(F.avg("y").alias("mu"), F.min("y").alias("low"))
    met = rows.join(means, KEY)
    away = F.get("w", F.lit(0)) - F.col("mu")
    sums = [F.sum(away * (F.get("w", F.lit(k)) - F.col("mu"))).alias(f"c{k}") for k in range(season + 1)]
    last = F.max(F.when(F.col("t") == F.col("n") - 1, F.get("w", F.lit(0)))).alias("last")
    found = met.groupBy(KEY).agg(F.max("n").alias("n"), F.max("low").alias("low"), last, *sums)
    rho = [F.try_divide(F.coalesce(F.col(f"c{k}"), F.lit(0.0)), F.col("c0")) for k in range(season + 1)]
    spread = F.lit(1.0)
    for k in range(1, season):
        spread = spread + 2 * rho[k] * rho[k]
    seasonal = (F.col("low") > 0) & (F.col("n") >= SEASONS * season) & (F.abs(rho[season]) > LEVEL * F.sqrt(spread / F.col("n")))
    place = F.pmod(F.col("t") + season // 2, F.lit(season)).cast("int")
    ratios = rows.select(KEY, place.alias("place"), _ratio(season).alias("ratio")).where("ratio is not null")
    mean = ratios.groupBy(KEY, "place").agg(F.avg("ratio").alias("ratio"))
    # One value for each place in the season.
    gathered = mean.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("place", "ratio"))).alias("p"), F.avg("ratio").alias("level"))
    indices = gathered.where(F.size("p") == season).select(KEY, F.transform("p", lambda v: v["ratio"] / F.col("level")).alias("indices"))
    out = found.join(indices, KEY, "left")
    holds = F.coalesce(seasonal & F.col("indices").isNotNull(), F.lit(False)) if season > 1 else F.lit(False)
    return out.select(KEY, "n", "last", holds.alias("seasonal"), "indices")


def naive2(points: DataFrame, season: int, horizon: int) -> DataFrame:
    """``(series, step, pred)``: the last value without its season, with the seasons to come; the last value where there is no season."""
    profile = seasonal_profile(points, season)
    steps = profile.select("*", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    now = F.get("indices", F.pmod(F.col("n") - 1, F.lit(season)).cast("int"))
    then = F.get("indices", F.pmod(F.col("n") + F.col("step"), F.lit(season)).cast("int"))
    return steps.select(KEY, "step", F.when(F.col("seasonal"), F.col("last") / now * then).otherwise(F.col("last")).alias("pred"))
