"""From raw long readings to a clean, regular, gap-filled table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.times import day_of, epoch_seconds
from gridcast.operators import axis, clean, fill, grid, quality
from gridcast.staging import MAX_ROWS, settle

# 15-minute readings and one day of interpolation.
STEP_SECONDS = 900
INTERPOLATION_LIMIT = 96


@dataclass(frozen=True)
class Rules:
    station_threshold: float = clean.STATION_THRESHOLD
    date_threshold: float = clean.DATE_THRESHOLD
    min_history: int = clean.MIN_HISTORY
    step_seconds: int = STEP_SECONDS
    limit: int = INTERPOLATION_LIMIT


@dataclass(frozen=True)
class Filtered:
    readings: DataFrame
    dropped_stations: DataFrame
    dropped_dates: DataFrame


def filter_readings(readings: DataFrame, rules: Rules = Rules(), facts: DataFrame | None = None) -> Filtered:
    """Drops bad stations and bad dates, then stations left without any value.

    All decisions are made on the daily facts; the readings are read once more,
    to be filtered.  ``dropped_dates`` lists only dates that the remaining
    stations really had; ``dropped_stations`` joins all reasons.
    """
    facts = settle(quality.station_date_facts(clean.drop_null_rows(readings))) if facts is None else facts
    listed_stations = settle(clean.bad_stations(quality.station_summary(facts), rules.station_threshold))
    listed_dates = settle(clean.bad_dates(quality.date_summary(facts), rules.date_threshold))
    kept = clean.exclude(facts, listed_stations, "station")
    dropped_dates = kept.select("date").distinct().join(listed_dates, "date", "left_semi")
    per_station = (
        kept.join(listed_dates.withColumn("_listed", F.lit(True)), "date", "left")
        .groupBy("station")
        .agg(F.sum(F.when(F.col("_listed").isNull(), F.col("total_points") - F.col("orig_missing"))).alias("_values"))
    )
    emptied = per_station.where(F.coalesce("_values", F.lit(0)) == 0).select("station")
    dropped_stations = listed_stations.union(emptied).distinct()
    filtered = clean.exclude(clean.drop_null_rows(readings), dropped_stations, "station")
    return Filtered(clean.exclude_dates(filtered, listed_dates), dropped_stations, dropped_dates)


def build_clean(readings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``(datetime, station, station_id, target, miss_target, date)`` on the full grid.

    Station ids cover every station of the input; stations with too little
    history are left out of the result, fully empty dates as well.  One pass over
    the readings gives counts and time ranges per station and day; ids, history,
    the grid's limits and the dates with values all come from those rows.
    """
    present = clean.drop_null_rows(readings, ["datetime", "station"])
    phase = F.pmod(epoch_seconds("datetime"), F.lit(rules.step_seconds)).alias("_phase")
    daily = settle(
        present.groupBy("station", day_of("datetime").alias("date"), phase).agg(
            F.count("target").alias("_values"), F.min("datetime").alias("_low"), F.max("datetime").alias("_high")
        )
    )
    limits = grid.Extent(*daily.agg(F.min("_low"), F.max("_high")).first())
    history = daily.groupBy("station").agg(F.sum("_values").alias("_values"))
    enough = history.where(F.col("_values") >= rules.min_history).select("station")
    wanted = axis.station_dimension(daily).join(enough, "station", "left_semi")
    gridded = grid.regular_grid(present, rules.step_seconds, limits=limits, carry=True, stations=wanted)
    filled = fill.fill_clean(grid.flag_missing(gridded), rules.limit).withColumn("date", day_of("datetime"))
    on_grid = (F.col("_phase") == limits.phase(rules.step_seconds)) & (F.col("_values") > 0)
    dates = daily.where(on_grid).join(enough, "station", "left_semi").select("date").distinct()
    # No more dates than days between the limits.
    dates = F.broadcast(dates) if limits.days() <= MAX_ROWS else dates
    kept = filled.join(dates, "date", "left_semi")
    return kept.select("datetime", "station", "station_id", "target", "miss_target", "date")


@dataclass(frozen=True)
class Curated:
    clean: DataFrame
    stations: DataFrame
    facts: DataFrame
    date_summary: DataFrame
    station_summary: DataFrame
    dropped_stations: DataFrame
    dropped_dates: DataFrame


def curate(readings: DataFrame, rules: Rules = Rules()) -> Curated:
    """All stages with their reports.  The two tables that several stages read are settled."""
    facts = settle(quality.station_date_facts(clean.drop_null_rows(readings)))
    filtered = filter_readings(readings, rules, facts)
    table = settle(build_clean(filtered.readings, rules))
    after = quality.station_date_facts(table, flag="miss_target")
    return Curated(
        table,
        table.select("station", "station_id").distinct(),
        after,
        quality.date_summary(after),
        quality.station_summary(after),
        filtered.dropped_stations,
        filtered.dropped_dates,
    )
