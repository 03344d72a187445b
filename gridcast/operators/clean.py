"""Projection, validation and exclusion of readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.numbers import is_finite
from gridcast.functions.times import NAIVE, day_of, parse_datetime
from gridcast.staging import small_side

LONG_COLUMNS = ("datetime", "station", "target")
# Names accepted for the measured column, in order of preference.
TARGET_NAMES = ("target", "load", "value", "power", "energy")
NOT_A_TARGET = ("datetime", "date", "time", "station")
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")
# Default quality thresholds.
FULLY_MISSING = 0.999999
STATION_THRESHOLD = 0.10
DATE_THRESHOLD = 0.30
CANDIDATE_THRESHOLD = 0.30
MIN_HISTORY = 672


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; the table has {df.columns}")
    return df


def canonical(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The long columns that are present, in canonical order."""
    return df.select(*[c for c in (*LONG_COLUMNS, *extra) if c in df.columns])


def resolve_target(df: DataFrame) -> str:
    for name in TARGET_NAMES:
        if name in df.columns:
            return name
    for name, kind in df.dtypes:
        if name.lower() not in NOT_A_TARGET and (kind in NUMERIC_TYPES or kind.startswith("decimal")):
            return name
    raise ValueError("no target-like column")


def resolve_station(df: DataFrame) -> str:
    if "station" in df.columns:
        return "station"
    named = [c for c in df.columns if "station" in c.lower()]
    if not named:
        raise ValueError("no station column")
    return named[0]


def resolve_datetime(df: DataFrame) -> Column:
    """Expression for the reading time, found by column name."""
    kinds = dict(df.dtypes)

    def read(name: str) -> Column:
        if kinds[name] == "string":
            return parse_datetime(name)
        return F.col(name).cast(NAIVE)

    if "datetime" in kinds:
        return read("datetime")
    if "date" in kinds and "time" in kinds:
        return parse_datetime(F.concat_ws(" ", F.col("date").cast("string"), F.col("time").cast("string")))
    if "date" in kinds:
        return read("date")
    for name in df.columns:
        if "date" in name.lower() or "time" in name.lower():
            return read(name)
    raise ValueError("no datetime-like column")


def resolve_roles(df: DataFrame) -> DataFrame:
    """``(datetime, station, target, miss_target)`` from a loosely named table."""
    target = F.col(resolve_target(df)).cast("double")
    return df.select(
        resolve_datetime(df).alias("datetime"),
        F.col(resolve_station(df)).cast("string").alias("station"),
        target.alias("target"),
        target.isNull().cast("tinyint").alias("miss_target"),
    )


def rename_target(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnRenamed(name, "target")


def drop_null_rows(df: DataFrame, subset: Sequence[str] = ("datetime",)) -> DataFrame:
    return df.dropna(subset=list(subset))


def mark_valid(readings: DataFrame) -> DataFrame:
    """``is_valid``: time, station and value are all present."""
    present = [F.col(c).isNotNull() for c in LONG_COLUMNS]
    return readings.withColumn("is_valid", present[0] & present[1] & present[2])


def clean_half(readings: DataFrame) -> DataFrame:
    return mark_valid(readings).where("is_valid").drop("is_valid")


def rejected_half(readings: DataFrame) -> DataFrame:
    return mark_valid(readings).where(~F.col("is_valid")).drop("is_valid")


def exclude(readings: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not listed."""
    return readings.join(small_side(listed.select(key)), key, "left_anti")


def exclude_dates(readings: DataFrame, dates: DataFrame) -> DataFrame:
    dated = readings.withColumn("_date", day_of("datetime"))
    return dated.join(small_side(dates.select(F.col("date").alias("_date"))), "_date", "left_anti").drop("_date")


def bad_stations(summary: DataFrame, threshold: float = STATION_THRESHOLD) -> DataFrame:
    rate = F.col("avg_daily_missing_rate")
    return summary.where((rate >= FULLY_MISSING) | (rate > threshold)).select("station").distinct()


def bad_dates(summary: DataFrame, threshold: float = DATE_THRESHOLD) -> DataFrame:
    return summary.where(F.col("pct_stations_missing") > threshold).select("date")


def fully_missing_dates(summary: DataFrame, computed: DataFrame) -> DataFrame:
    """Dates missing at every station by the summary, else the computed empty dates."""
    listed = summary.where(F.col("pct_stations_missing") == 1.0).select("date")
    any_listed = F.coalesce(listed.agg(F.max(F.lit(True))).scalar(), F.lit(False))
    fallback = computed.withColumn("_listed", any_listed).where(~F.col("_listed")).select("date")
    return listed.unionByName(fallback).distinct()


def candidate_stations(summary: DataFrame, threshold: float = CANDIDATE_THRESHOLD) -> DataFrame:
    return summary.where(F.col("avg_daily_missing_rate") <= threshold).orderBy("avg_daily_missing_rate", "station")


def with_min_history(readings: DataFrame, minimum: int = MIN_HISTORY, key: str = "station") -> DataFrame:
    """Stations with at least ``minimum`` values."""
    enough = readings.groupBy(key).agg(F.count("target").alias("_n")).where(F.col("_n") >= minimum).select(key)
    return readings.join(small_side(enough), key, "left_semi")


def without_empty_stations(readings: DataFrame, empty: DataFrame) -> DataFrame:
    return exclude(readings, empty, "station")


def non_finite_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, NULLs and non-finite values per column, one row per column."""
    counts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.count_if(F.col(c).isNotNull() & ~is_finite(c)).alias("non_finite"),
        )
        for c in columns
    ]
    return df.agg(F.array(*counts).alias("_c")).select(F.inline("_c"))


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows; the job fails on the first NULL or non-finite value."""
    guarded = {
        c: F.when(is_finite(c), F.col(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"non-finite {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
        )
        for c in columns
    }
    return df.withColumns(guarded)
