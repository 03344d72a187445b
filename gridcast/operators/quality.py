"""Missingness facts and their roll-ups.  Every one is a partial-then-final aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.numbers import ratio_or_zero
from gridcast.functions.times import day_of
from gridcast.staging import spread_groups


def _missing_counts(df: DataFrame, *keys) -> DataFrame:
    counts = (F.count(F.lit(1)).alias("total_points"), F.count_if(F.col("target").isNull()).alias("missing_points"))
    grouped = df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)
    return grouped.withColumn("missing_rate", ratio_or_zero(F.col("missing_points"), F.col("total_points")))


def overall_missing(readings: DataFrame) -> DataFrame:
    return _missing_counts(readings)


def missing_by_station(readings: DataFrame) -> DataFrame:
    return _missing_counts(readings, "station")


def missing_by_date(readings: DataFrame) -> DataFrame:
    return _missing_counts(readings, day_of("datetime").alias("date"))


def station_date_facts(readings: DataFrame, flag: str | None = None) -> DataFrame:
    """One row per station and day.  ``flag`` names a 0/1 column for tables already filled."""
    missing = F.col("target").isNull() if flag is None else F.col(flag) == 1
    dated = readings.select("station", day_of("datetime").alias("date"), missing.alias("_missing"))
    return (
        spread_groups(dated, "station", "date")
        .groupBy("station", "date")
        .agg(F.count(F.lit(1)).alias("total_points"), F.count_if("_missing").alias("orig_missing"))
        .withColumn("orig_missing_rate", ratio_or_zero(F.col("orig_missing"), F.col("total_points")))
    )


def date_summary(facts: DataFrame) -> DataFrame:
    """Per date.  Several facts of one station and date count that station once."""
    return (
        facts.groupBy("date", "station")
        .agg(F.count_if(F.col("orig_missing") > 0).alias("_hit"), F.sum("orig_missing").alias("_points"))
        .groupBy("date")
        .agg(
            F.sum("_hit").alias("stations_with_missing"),
            F.sum("_points").alias("total_missing_points"),
            F.count(F.lit(1)).alias("stations_reported"),
        )
        .withColumn("pct_stations_missing", ratio_or_zero(F.col("stations_with_missing"), F.col("stations_reported")))
    )


def station_summary(facts: DataFrame) -> DataFrame:
    """Per station: days reported, mean of the daily rates, total missing points.

    Rates are added up as decimals of 26 places: the mean is the same in whatever order facts
    arrive, and a mean that equals a threshold does not pass it by a rounding error.
    """
    rate = F.try_divide(F.col("orig_missing").cast("decimal(38,26)"), F.col("total_points").cast("decimal(12,0)"))
    return (
        facts.groupBy("station", "date")
        .agg(
            F.sum(F.coalesce(rate, F.lit(0))).alias("_rates"),
            F.count(F.lit(1)).alias("_facts"),
            F.sum("orig_missing").alias("_points"),
        )
        .groupBy("station")
        .agg(
            F.count(F.lit(1)).alias("days_reported"),
            F.try_divide(F.sum("_rates"), F.sum("_facts").cast("decimal(12,0)")).cast("double").alias("avg_daily_missing_rate"),
            F.sum("_points").alias("total_missing_points"),
        )
    )


def empty_stations(readings: DataFrame) -> DataFrame:
    return (
        readings.groupBy("station")
        .agg(F.count("target").alias("_n"))
        .where(F.col("_n") == 0)
        .select("station")
    )


def empty_dates(readings: DataFrame) -> DataFrame:
    """Dates on which no station has a value."""
    return (
        readings.groupBy(day_of("datetime").alias("date"))
        .agg(F.count("target").alias("_n"))
        .where(F.col("_n") == 0)
        .select("date")
    )


def date_coverage(readings: DataFrame) -> DataFrame:
    """Per date: stations without any value, a station absent that day included.

    Counting (station, date) pairs that do carry a value gives the same answer
    as looking every pair up, without building the pairs.
    """
    stations = readings.agg(F.countDistinct("station")).scalar()
    return (
        readings.groupBy(day_of("datetime").alias("date"), "station")
        .agg(F.count("target").alias("_n"))
        .groupBy("date")
        .agg(F.count_if(F.col("_n") > 0).alias("_present"))
        .withColumn("stations_total", stations)
        .select(
            "date",
            (F.col("stations_total") - F.col("_present")).alias("stations_with_missing"),
            "stations_total",
        )
        .withColumn("pct_stations_missing", ratio_or_zero(F.col("stations_with_missing"), F.col("stations_total")))
    )


def station_list(readings: DataFrame) -> DataFrame:
    return readings.select("station").distinct().orderBy("station")


def station_count(readings: DataFrame) -> DataFrame:
    return readings.agg(F.countDistinct("station").alias("stations"))


def filled_share(clean: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return clean.agg(
        total.alias("rows"), ratio_or_zero(F.sum(F.col("miss_target").cast("long")), total).alias("filled_share")
    )


def clean_counts(marked: DataFrame) -> DataFrame:
    """Original, clean and dropped counts of a table with ``is_valid``."""
    return marked.agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if("is_valid").alias("clean_rows"),
        F.count_if(~F.col("is_valid")).alias("dropped_rows"),
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL/NaN and infinity counts, minimum and maximum per numeric column, in one scan."""
    numeric = columns or [n for n, k in df.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    inf = F.lit(float("inf"))

    def profile(name: str):
        v = F.col(name).cast("double")
        real = F.when(~F.isnan(v) & (F.abs(v) != inf), v)
        return F.struct(
            F.lit(name).alias("column_name"),
            F.count_if(v.isNull() | F.isnan(v)).alias("nan_count"),
            F.count_if(F.abs(v) == inf).alias("inf_count"),
            F.min(real).alias("min_value"),
            F.max(real).alias("max_value"),
        )

    row = df.agg(F.array(*[profile(n) for n in numeric]).alias("_p"))
    return row.select(F.inline("_p")).withColumn(
        "all_finite", (F.col("nan_count") == 0) & (F.col("inf_count") == 0)
    )


def top(df: DataFrame, k: int, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties in order of ``tie``."""
    return df.orderBy(*[F.desc(c) for c in by], *tie).limit(k)


def ranked(df: DataFrame, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in by], *tie)


def canonical_sort(readings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by station and time, ready for a sorted sink."""
    cols = ("station", "datetime")
    spread = readings.repartitionByRange(partitions, *cols) if partitions else readings.repartitionByRange(*cols)
    return spread.sortWithinPartitions(*cols)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once; only repeated keys travel back to the rows."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows")).where(F.col("key_rows") > 1)
    return df.join(repeated, key)


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``left`` absent from ``right``."""
    keys = left.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(right.select(key), key, "left_anti")


