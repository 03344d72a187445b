"""Forecast metrics over rows ``(…, step, pred, true)``.

Each metric is one aggregate with partial sums; ``by`` groups them (horizon,
pattern, mode).  Definitions follow the published formulas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.numbers import divide_or_zero

# Fixed value: guard in the percentage metrics.
PERCENT_EPS = 1e-8


def _err() -> Column:
    return F.col("pred") - F.col("true")


def mae() -> Column:
    return F.avg(F.abs(_err()))


def mse() -> Column:
    return F.avg(_err() * _err())


def rmse() -> Column:
    return F.sqrt(mse())


def mape() -> Column:
    """Share, no guard; rows with a zero truth do not count (see ``zero_truths``)."""
    return F.avg(F.abs(F.try_divide(_err(), F.col("true"))))


def mspe() -> Column:
    ratio = F.try_divide(_err(), F.col("true"))
    return F.avg(ratio * ratio)


def zero_truths() -> Column:
    return F.count_if(F.col("true") == 0)


def rse() -> Column:
    spread = F.var_pop("true") * F.count("true")
    return F.try_divide(F.sqrt(F.sum(_err() * _err())), F.sqrt(spread))


def smape() -> Column:
    size = F.abs(F.col("pred")) + F.abs(F.col("true")) + F.lit(PERCENT_EPS)
    return F.avg(200.0 * F.abs(_err()) / size)


def mape_percent() -> Column:
    return F.avg(F.abs(100.0 * _err() / (F.col("true") + F.lit(PERCENT_EPS))))


def masked_mape() -> Column:
    """Mean over all cells, masked ones included as 0."""
    return F.avg(F.abs(_err() * divide_or_zero(F.col("mask"), F.col("true"))))


def masked_smape() -> Column:
    size = F.abs(F.col("pred")) + F.abs(F.col("true"))
    return 200.0 * F.avg(divide_or_zero(F.abs(_err()), size) * F.col("mask"))


def masked_mase() -> Column:
    """Needs the per-series seasonal ``scale`` on each row."""
    return F.avg(F.abs(_err()) * divide_or_zero(F.col("mask"), F.col("scale")))


def aggregate(table: DataFrame, by: Sequence[str] = (), /, **metrics: Column) -> DataFrame:
    columns = [m.alias(name) for name, m in metrics.items()]
    return table.groupBy(*by).agg(*columns) if by else table.agg(*columns)


def bundle(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The standard five, plus the number of rows and of zero truths."""
    return aggregate(
        rows,
        by,
        rows=F.count(F.lit(1)),
        zero_truths=zero_truths(),
        mae=mae(),
        mse=mse(),
        rmse=rmse(),
        mape=mape(),
        mspe=mspe(),
    )


def step_correlation(rows: DataFrame) -> DataFrame:
    """Per step: sum of products of centred values over the root of the sum of products
    of their squares; then the mean over steps.

    Not the usual correlation.  The broadcast side has one row per step, so no
    more rows than the horizon has points.
    """
    means = rows.groupBy("step").agg(F.avg("true").alias("_mt"), F.avg("pred").alias("_mp"))
    a, b = F.col("true") - F.col("_mt"), F.col("pred") - F.col("_mp")
    per_step = (
        rows.join(F.broadcast(means), "step")
        .groupBy("step")
        .agg(F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a * b * b))).alias("_c"))
    )
    return per_step.agg(F.avg("_c").alias("corr"))


def seasonal_scale(insample: Column, freq: int) -> Column:
    """Mean absolute seasonal difference of one insample array, padding included."""
    n = F.size(insample)
    later = F.slice(insample, F.lit(freq + 1), n - freq)
    earlier = F.slice(insample, F.lit(1), n - freq)
    total = F.aggregate(F.zip_with(later, earlier, lambda u, v: F.abs(u - v)), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(n > freq, total / (n - freq))


def batch_weighted(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """Two means of the squared error: batches weighted by size, and unweighted."""
    per_batch = rows.groupBy(batch).agg(
        F.avg(_err() * _err()).alias("_loss"), F.count(F.lit(1)).alias("_n")
    )
    return per_batch.agg(
        (F.sum(F.col("_loss") * F.col("_n")) / F.sum("_n")).alias("weighted_loss"),
        F.avg("_loss").alias("unweighted_loss"),
        F.count(F.lit(1)).alias("batches"),
    )


def pattern_summary(rows: DataFrame, naive: DataFrame | None = None) -> DataFrame:
    """SMAPE, MAPE and MASE per seasonal pattern and their series-weighted mean.

    ``rows`` carries ``pattern, series, pred, true, mask, scale``.  ``naive``
    (``pattern, smape, mase`` of the benchmark forecast) adds the overall
    weighted average; it has one row per pattern.
    """
    per_pattern = rows.groupBy("pattern").agg(
        F.countDistinct("series").alias("series_count"),
        masked_smape().alias("smape"),
        (100.0 * masked_mape()).alias("mape"),
        masked_mase().alias("mase"),
    )
    n = F.col("series_count")

    def weighted(name: str) -> Column:
        return (F.sum(F.col(name) * n) / F.sum(n)).alias(name)

    measures = ["smape", "mape", "mase"]
    if naive is not None:
        bench = naive.select("pattern", F.col("smape").alias("_ns"), F.col("mase").alias("_nm"))
        owa = (F.try_divide(F.col("smape"), F.col("_ns")) + F.try_divide(F.col("mase"), F.col("_nm"))) / 2
        per_pattern = per_pattern.join(bench, "pattern").withColumn("owa", owa).drop("_ns", "_nm")
        measures.append("owa")
    total = per_pattern.agg(F.sum(n).alias("series_count"), *[weighted(m) for m in measures])
    return per_pattern.unionByName(total.withColumn("pattern", F.lit("Average")).select(per_pattern.columns))
