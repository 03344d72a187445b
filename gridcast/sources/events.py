"""Readings, series, marks and weather taken from relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.times import NAIVE, day_of, floor_time


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings(
    source: DataFrame,
    time: str,
    station: Column,
    target: Column,
    step_seconds: int | None = None,
) -> DataFrame:
    """``(datetime, station, target)`` from any table with a time and a value."""
    when = floor_time(time, step_seconds) if step_seconds else F.col(time).cast(NAIVE)
    return source.select(when.alias("datetime"), station.cast("string").alias("station"), target.cast("double").alias("target"))


def type_readings(spark: SparkSession, folder: str, step_seconds: int | None = 3600) -> DataFrame:
    """One station per event type."""
    events = table(spark, folder, "events")
    return readings(events, "ts", F.col("event_type"), F.col("value"), step_seconds)


def user_readings(spark: SparkSession, folder: str, step_seconds: int | None = 3600) -> DataFrame:
    """One station per user; an error event is a reading without a value."""
    events = table(spark, folder, "events")
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return readings(events, "ts", F.col("user_id"), value, step_seconds)


def shipment_readings(spark: SparkSession, folder: str) -> DataFrame:
    """One station per supplier, one reading per shipped line; returned lines carry no value."""
    lines = table(spark, folder, "lineitem")
    value = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    return readings(lines, "l_shipdate", F.col("l_suppkey"), value)


def order_series(spark: SparkSession, folder: str) -> DataFrame:
    """One series per customer: order totals by date, then order key; pending orders have none yet."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("series"),
        F.col("o_orderdate").cast(NAIVE).alias("at"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("y"),
    )


def daily_weather(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean of event values per user, under the cleaned station name."""
    events = table(spark, folder, "events")
    return events.groupBy(F.concat(F.lit("Zone "), F.col("user_id")).alias("station_clean"), day_of("ts").alias("date")).agg(
        F.avg("value").alias("temperature")
    )


def embedding_marks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("t"), F.col("embedding").alias("emb"))
