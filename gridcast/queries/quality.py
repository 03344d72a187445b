"""Missingness facts, roll-ups, reports and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.times import day_of
from gridcast.operators import axis, clean, grid
from gridcast.operators import fill as fills
from gridcast.operators import quality as Q
from gridcast.queries.base import (
    SHIP,
    TYPE_H,
    USER_H,
    dates_sql,
    day,
    facts_sql,
    grid_sql,
    query,
    r6,
    stamp,
    stations_sql,
)
from gridcast.sources import events as E

HOUR = 3600
COUNTS = (
    "count(*) AS total_points, count(*) FILTER (target IS NULL) AS missing_points, "
    + r6("CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (target IS NULL) AS DOUBLE) / count(*) ELSE 0 END")
    + " AS missing_rate"
)
ROWS_BY_DATE = (
    f"SELECT {day('date')} AS date, stations_with_missing, total_missing_points, stations_reported, "
    f"{r6('pct_stations_missing')} AS pct_stations_missing FROM by_date"
)
ROWS_BY_STATION = (
    f"SELECT station, days_reported, {r6('avg_daily_missing_rate')} AS avg_daily_missing_rate, total_missing_points FROM by_station"
)


@query("a01_overall_missing", f"WITH {SHIP} SELECT {COUNTS} FROM ship")
def _(spark, d):
    return Q.overall_missing(E.shipment_readings(spark, d))


@query("a02_missing_by_station", f"WITH {SHIP} SELECT station, {COUNTS} FROM ship GROUP BY station")
def _(spark, d):
    return Q.missing_by_station(E.shipment_readings(spark, d))


@query(
    "a03_missing_by_date",
    f"WITH {SHIP} SELECT {day('CAST(datetime AS DATE)')} AS date, {COUNTS} FROM ship GROUP BY CAST(datetime AS DATE)",
)
def _(spark, d):
    return Q.missing_by_date(E.shipment_readings(spark, d))


@query(
    "a04_station_date_facts",
    f"WITH {SHIP}, {facts_sql('ship')} SELECT station, {day('date')} AS date, total_points, orig_missing, "
    f"{r6('orig_missing_rate')} AS orig_missing_rate FROM facts",
)
def _(spark, d):
    return Q.station_date_facts(E.shipment_readings(spark, d))


@query(
    "a04_station_date_facts_filled",
    f"WITH {USER_H}, {grid_sql('user_h')}, {facts_sql('grid')} SELECT station, {day('date')} AS date, total_points, "
    f"orig_missing, {r6('orig_missing_rate')} AS orig_missing_rate FROM facts",
)
def _(spark, d):
    flagged = grid.flag_missing(grid.regular_grid(E.user_readings(spark, d), HOUR, carry=True))
    return Q.station_date_facts(fills.fill_linear(flagged), flag="miss_target")


@query("a05_date_summary", f"WITH {SHIP}, {facts_sql('ship')}, {dates_sql()} {ROWS_BY_DATE}")
def _(spark, d):
    return Q.date_summary(Q.station_date_facts(E.shipment_readings(spark, d)))


@query("a06_station_summary", f"WITH {SHIP}, {facts_sql('ship')}, {stations_sql()} {ROWS_BY_STATION}")
def _(spark, d):
    return Q.station_summary(Q.station_date_facts(E.shipment_readings(spark, d)))


@query(
    "flagship_top_missing_stations",
    f"WITH {TYPE_H}, {grid_sql('type_h')}, {facts_sql('grid')}, {stations_sql()} {ROWS_BY_STATION} "
    "ORDER BY by_station.avg_daily_missing_rate DESC, station LIMIT 10",
)
def top_missing_stations(spark, d):
    gridded = grid.regular_grid(E.type_readings(spark, d), HOUR)
    summary = Q.station_summary(Q.station_date_facts(gridded))
    return Q.top(summary, 10, ["avg_daily_missing_rate"], ["station"])


ERRORS_ONLY = "SELECT datetime, station, CASE WHEN station <> 'error' THEN target END AS target FROM type_h"


def _without_error_values(spark, d):
    return E.type_readings(spark, d).withColumn("target", F.when(F.col("station") != "error", F.col("target")))


@query(
    "a07_empty_stations",
    f"WITH {TYPE_H}, r AS ({ERRORS_ONLY}) SELECT station FROM r GROUP BY station HAVING count(target) = 0",
)
def _(spark, d):
    return Q.empty_stations(_without_error_values(spark, d))


# A station that reports on its own days only: user-days with nothing but errors become empty.
USER_DAY = (
    "user_day AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS datetime, CAST(user_id AS VARCHAR) AS station, "
    "CASE WHEN event_type = 'purchase' AND value > 150 THEN value END AS target FROM events)"
)


def _rare_purchases(spark, d):
    source = E.table(spark, d, "events")
    value = F.when((F.col("event_type") == "purchase") & (F.col("value") > 150), F.col("value"))
    return E.readings(source, "ts", F.col("user_id"), value, 24 * HOUR)


@query(
    "a08_empty_dates",
    f"WITH {USER_DAY} SELECT {day('CAST(datetime AS DATE)')} AS date FROM user_day "
    "GROUP BY CAST(datetime AS DATE) HAVING count(target) = 0",
)
def _(spark, d):
    return Q.empty_dates(_rare_purchases(spark, d))


COVERAGE = (
    "pairs AS (SELECT dd.date, s.station FROM (SELECT DISTINCT CAST(datetime AS DATE) AS date FROM {src}) dd "
    "CROSS JOIN (SELECT DISTINCT station FROM {src}) s), "
    "counts AS (SELECT CAST(datetime AS DATE) AS date, station, count(target) AS n FROM {src} GROUP BY 1, 2), "
    "looked AS (SELECT p.date, p.station, coalesce(c.n, 0) AS n FROM pairs p LEFT JOIN counts c "
    "ON c.date = p.date AND c.station = p.station) "
    "SELECT strftime(date, '%Y-%m-%d') AS date, count(*) FILTER (n = 0) AS stations_with_missing, count(*) AS stations_total, "
    "round(CAST(count(*) FILTER (n = 0) AS DOUBLE) / count(*), 6) AS pct_stations_missing FROM looked GROUP BY looked.date"
)


@query("a08_date_coverage", f"WITH {USER_DAY}, {COVERAGE.format(src='user_day')}")
def _(spark, d):
    return Q.date_coverage(_rare_purchases(spark, d))


@query("j07_station_date_lookup", f"WITH {SHIP}, {COVERAGE.format(src='ship')}")
def _(spark, d):
    return Q.date_coverage(E.shipment_readings(spark, d))


@query(
    "a09_mean_duplicates",
    f"WITH {TYPE_H} SELECT station, {stamp('datetime')} AS datetime, {r6('avg(target)')} AS target FROM type_h GROUP BY station, type_h.datetime",
)
def _(spark, d):
    return grid.mean_duplicates(E.type_readings(spark, d))


@query("a10_station_list", f"WITH {SHIP} SELECT DISTINCT station FROM ship ORDER BY station")
def _(spark, d):
    return Q.station_list(E.shipment_readings(spark, d))


@query("a10_station_count", f"WITH {SHIP} SELECT count(DISTINCT station) AS stations FROM ship")
def _(spark, d):
    return Q.station_count(E.shipment_readings(spark, d))


@query(
    "a11_time_extent",
    f"WITH {TYPE_H} SELECT {stamp('min(datetime)')} AS first_datetime, {stamp('max(datetime)')} AS last_datetime FROM type_h",
)
def _(spark, d):
    return grid.extent(E.type_readings(spark, d))


@query(
    "a12_incomplete_stations",
    f"WITH {USER_H}, m AS (SELECT station, datetime, avg(target) AS target FROM user_h GROUP BY ALL) "
    "SELECT station, count(*) AS rows, (SELECT count(DISTINCT datetime) FROM m) AS expected FROM m GROUP BY station "
    "HAVING count(*) <> (SELECT count(DISTINCT datetime) FROM m)",
)
def _(spark, d):
    return grid.incomplete_stations(grid.mean_duplicates(E.user_readings(spark, d)))


@query(
    "a13_filled_share",
    f"WITH {USER_H}, {grid_sql('user_h')} SELECT count(*) AS rows, "
    f"{r6('avg(CASE WHEN target IS NULL THEN 1.0 ELSE 0.0 END)')} AS filled_share FROM grid",
)
def _(spark, d):
    return Q.filled_share(grid.flag_missing(grid.regular_grid(E.user_readings(spark, d), HOUR)))


def _profile_sql(columns, source):
    parts = []
    for c in columns:
        v = f"CAST({c} AS DOUBLE)"
        real = f"CASE WHEN isfinite({v}) THEN {v} END"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({v} IS NULL OR isnan({v})) AS nan_count, "
            f"count(*) FILTER (isinf({v})) AS inf_count, {r6(f'min({real})')} AS min_value, {r6(f'max({real})')} AS max_value, "
            f"(count(*) FILTER ({v} IS NULL OR isnan({v})) = 0 AND count(*) FILTER (isinf({v})) = 0) AS all_finite FROM {source}"
        )
    return " UNION ALL ".join(parts)


RATIOS = (
    "ratios AS (SELECT value, CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE WHEN event_type = 'view' "
    "THEN 'Infinity'::DOUBLE ELSE value / 2 END AS ratio, CAST(user_id AS DOUBLE) AS user_number FROM events)"
)


def _ratios(spark, d):
    kind = F.col("event_type")
    ratio = F.when(kind == "error", F.lit(float("nan"))).when(kind == "view", F.lit(float("inf"))).otherwise(F.col("value") / 2)
    return E.table(spark, d, "events").select("value", ratio.alias("ratio"), F.col("user_id").cast("double").alias("user_number"))


@query("a17_numeric_profile", f"WITH {RATIOS} {_profile_sql(['value', 'ratio', 'user_number'], 'ratios')}")
def _(spark, d):
    return Q.numeric_profile(_ratios(spark, d))


@query(
    "p24_non_finite_guard",
    f"WITH {RATIOS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, "
        f"count(*) FILTER (NOT isfinite({c})) AS non_finite FROM ratios"
        for c in ("value", "ratio")
    ),
)
def _(spark, d):
    return clean.non_finite_report(_ratios(spark, d), ["value", "ratio"])


@query(
    "f17_finite_tests",
    f"WITH {RATIOS} SELECT count(*) FILTER (isnan(ratio)) AS nan_rows, count(*) FILTER (isinf(ratio)) AS inf_rows, "
    "count(*) FILTER (isfinite(ratio)) AS finite_rows FROM ratios",
)
def _(spark, d):
    from gridcast.functions.numbers import INFINITY, is_finite

    r = F.col("ratio")
    return _ratios(spark, d).agg(
        F.count_if(F.isnan(r)).alias("nan_rows"),
        F.count_if(F.abs(r) == INFINITY).alias("inf_rows"),
        F.count_if(is_finite(r)).alias("finite_rows"),
    )


@query(
    "a18_median_fallback",
    f"WITH {USER_H}, med AS (SELECT station, median(target) AS m FROM user_h GROUP BY station) "
    f"SELECT u.station, {stamp('u.datetime')} AS datetime, {r6('coalesce(u.target, med.m, 0.0)')} AS target "
    "FROM user_h u LEFT JOIN med ON med.station = u.station",
)
def _(spark, d):
    return fills.fill_with_median(E.user_readings(spark, d)).select("station", "datetime", "target")


@query(
    "a19_time_axis",
    f"WITH {USER_H}, a AS (SELECT DISTINCT datetime FROM user_h WHERE target IS NOT NULL) "
    f"SELECT row_number() OVER (ORDER BY a.datetime) - 1 AS t, {stamp('a.datetime')} AS datetime FROM a",
)
def _(spark, d):
    return axis.time_axis(E.user_readings(spark, d))


@query(
    "a20_clean_counts",
    f"WITH {USER_H} SELECT count(*) AS original_rows, count(*) FILTER (target IS NOT NULL) AS clean_rows, "
    "count(*) FILTER (target IS NULL) AS dropped_rows FROM user_h",
)
def _(spark, d):
    return Q.clean_counts(clean.mark_valid(E.user_readings(spark, d)))


# ---- sorts and reports ---------------------------------------------------------


@query(
    "o01_canonical_sort",
    f"WITH {USER_H} SELECT {stamp('datetime')} AS datetime, station, {r6('target')} AS target FROM user_h ORDER BY station, user_h.datetime",
)
def _(spark, d):
    return Q.canonical_sort(E.user_readings(spark, d))


@query(
    "o02_top_stations",
    f"WITH {SHIP} SELECT station, {COUNTS} FROM ship GROUP BY station ORDER BY "
    "CAST(count(*) FILTER (target IS NULL) AS DOUBLE) / count(*) DESC, station LIMIT 10",
)
def _(spark, d):
    return Q.top(Q.missing_by_station(E.shipment_readings(spark, d)), 10, ["missing_rate"], ["station"])


@query(
    "o03_dates_by_missing",
    f"WITH {SHIP}, {facts_sql('ship')}, {dates_sql()} {ROWS_BY_DATE} "
    "ORDER BY by_date.stations_with_missing DESC, by_date.total_missing_points DESC, by_date.date",
)
def _(spark, d):
    summary = Q.date_summary(Q.station_date_facts(E.shipment_readings(spark, d)))
    return Q.ranked(summary, ["stations_with_missing", "total_missing_points"], ["date"])


@query(
    "o04_sorted_dates",
    f"WITH {SHIP} SELECT DISTINCT {day('CAST(datetime AS DATE)')} AS date FROM ship ORDER BY date",
)
def _(spark, d):
    return E.shipment_readings(spark, d).select(day_of("datetime").alias("date")).distinct().orderBy("date")


@query(
    "o05_head_of_bad_rows",
    f"WITH {USER_H}, bad AS (SELECT DISTINCT station, datetime FROM user_h WHERE target IS NULL ORDER BY station, datetime LIMIT 20) "
    f"SELECT station, {stamp('datetime')} AS datetime FROM bad",
)
def _(spark, d):
    rejected = clean.rejected_half(E.user_readings(spark, d))
    return rejected.select("station", "datetime").distinct().orderBy("station", "datetime").limit(20)
