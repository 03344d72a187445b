"""Appending new long files and keeping daily missingness up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridcast.functions.numbers import parse_number, ratio_or_zero
from gridcast.functions.times import epoch_seconds, parse_datetime
from gridcast.sources.longwide import LONG_SCHEMA, tidy


def long_stream(spark: SparkSession, folder: str, pattern: str = "*_long.csv", files_per_batch: int = 1000) -> DataFrame:
    """Long readings of files as they appear; rows without a valid time are left out."""
    raw = (
        spark.readStream.schema(LONG_SCHEMA)
        .option("header", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    return raw.select(
        parse_datetime("datetime").alias("datetime"), "station", parse_number(tidy(F.col("target"))).alias("target")
    ).where(F.col("datetime").isNotNull())


def append_stream(readings: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Appends each batch once to a Parquet table and stops when all files are in.

    ``progress`` is the folder that remembers which files were taken; keep it on
    shared storage.
    """
    return (
        readings.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(path)
    )


def station_date_stream(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily facts per station, final once readings can no longer arrive.

    Watermarks need instants, so the naive clock is read as UTC: days then match
    the batch facts in any session time zone.
    """
    timed = readings.withColumn("_at", F.timestamp_seconds(epoch_seconds("datetime"))).withWatermark("_at", late)
    day = F.floor(F.unix_seconds("_day.start") / 86_400).cast("int")
    return (
        timed.groupBy(F.window("_at", "1 day").alias("_day"), "station")
        .agg(F.count(F.lit(1)).alias("total_points"), F.count_if(F.col("target").isNull()).alias("orig_missing"))
        .select(
            "station",
            F.date_from_unix_date(day).alias("date"),
            "total_points",
            "orig_missing",
            ratio_or_zero(F.col("orig_missing"), F.col("total_points")).alias("orig_missing_rate"),
        )
    )
