"""Attaching station ids, weather and other dimensions.

A dimension is copied to the executors only after its size was measured;
otherwise the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.text import strip_voltage_tag
from gridcast.operators.quality import duplicate_keys, unmatched_keys
from gridcast.staging import small_side


def attach_station_id(readings: DataFrame, stations: DataFrame) -> DataFrame:
    return readings.join(small_side(stations.select("station", "station_id")), "station", "left")


def clean_station_map(stations: DataFrame) -> DataFrame:
    return stations.withColumn("station_clean", strip_voltage_tag("station"))


def attach_weather_station_id(weather: DataFrame, stations: DataFrame) -> DataFrame:
    """Station id on the cleaned name; of several ids under one name the largest counts."""
    ids = clean_station_map(stations).groupBy("station_clean").agg(F.max("station_id").alias("station_id"))
    return weather.join(small_side(ids), "station_clean", "left")


def unmatched_weather(weather: DataFrame, stations: DataFrame) -> DataFrame:
    return unmatched_keys(weather, clean_station_map(stations), "station_clean")


def ambiguous_stations(stations: DataFrame) -> DataFrame:
    """Stations whose cleaned name is shared with another station."""
    return duplicate_keys(clean_station_map(stations), "station_clean")
