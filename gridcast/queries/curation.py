"""Projection, validation, exclusion, dimension joins, set operations, whole curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.text import strip_voltage_tag
from gridcast.functions.times import compose_datetime, day_of, iso_day, parse_datetime, parse_strict_date
from gridcast.functions.numbers import parse_number
from gridcast.operators import axis, clean, dims, grid
from gridcast.operators import quality as Q
from gridcast.plans import curation as plan
from gridcast.queries.base import (
    LINEAR,
    SHIP,
    TYPE_H,
    USER_H,
    dates_sql,
    day,
    facts_sql,
    grid_sql,
    ids_sql,
    near_sql,
    query,
    r6,
    stamp,
    stations_sql,
)
from gridcast.sources import events as E
from gridcast.sources.longwide import unpivot_clocks, tidy

HOUR = 3600
LONG = f"{stamp('datetime')} AS datetime, station, {r6('target')} AS target"


# ---- wide tables ---------------------------------------------------------------

CLOCKS = [f"{h:02d}:00" for h in range(24)]
# Mean per station, day and hour as one row per day, hours without a reading empty.
WIDE = (
    "wide AS (SELECT station, CAST(datetime AS DATE) AS date, hour(datetime) AS h, avg(target) AS target FROM type_h GROUP BY ALL), "
    "days AS (SELECT DISTINCT station, date FROM wide), "
    "hours AS (SELECT CAST(range AS BIGINT) AS h FROM range(24)), "
    "long AS (SELECT d.station, d.date, hours.h, w.target FROM days d CROSS JOIN hours "
    "LEFT JOIN wide w ON w.station = d.station AND w.date = d.date AND w.h = hours.h)"
)


def wide_table(spark, d):
    """One row per station and day with a column per hour, date like ``01JAN2024``."""
    rows = E.type_readings(spark, d).select(
        "station", day_of("datetime").alias("_date"), F.date_format("datetime", "HH:mm").alias("clock"), "target"
    )
    wide = rows.groupBy("station", "_date").pivot("clock", CLOCKS).agg(F.avg("target"))
    return wide.withColumn("Date", F.upper(F.date_format("_date", "ddMMMyyyy"))).drop("_date")


@query(
    "p01_unpivot",
    f"WITH {TYPE_H}, {WIDE} SELECT station, upper(strftime(date, '%d%b%Y')) AS Date, "
    f"printf('%02d:00', h) AS time, {r6('target')} AS target FROM long",
)
def _(spark, d):
    return unpivot_clocks(wide_table(spark, d), ["station", "Date"])


@query(
    "p02_compose_datetime",
    f"WITH {TYPE_H}, {WIDE} SELECT station, strftime(date + to_hours(h), '%Y-%m-%d %H:%M:%S') AS datetime, "
    f"{r6('target')} AS target FROM long",
)
def _(spark, d):
    long = unpivot_clocks(wide_table(spark, d), ["station", "Date"])
    return long.select("station", compose_datetime(parse_strict_date("Date"), "time").alias("datetime"), "target")


DATE_TEXT = (
    "texts AS (SELECT event_id, CASE event_type WHEN 'click' THEN upper(strftime(ts, '%d%b%Y')) "
    "WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'signup' THEN strftime(ts, '%m/%d/%Y') "
    "WHEN 'error' THEN strftime(ts, '%Y.%m.%d') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS txt, event_type, ts FROM events)"
)


def _date_texts(spark, d):
    t, k = F.col("ts"), F.col("event_type")
    text = (
        F.when(k == "click", F.upper(F.date_format(t, "ddMMMyyyy")))
        .when(k == "view", F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        .when(k == "signup", F.date_format(t, "MM/dd/yyyy"))
        .when(k == "error", F.date_format(t, "yyyy.MM.dd"))
        .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm"))
    )
    return E.table(spark, d, "events").select("event_id", text.alias("txt"))


@query(
    "p03_strict_date",
    f"WITH {DATE_TEXT} SELECT event_id, CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') END AS parsed FROM texts",
)
def _(spark, d):
    return _date_texts(spark, d).select("event_id", parse_strict_date("txt").alias("parsed"))


@query(
    "p04_lenient_datetime",
    f"WITH {DATE_TEXT} SELECT event_id, CASE WHEN event_type IN ('click', 'signup') THEN strftime(ts, '%Y-%m-%d 00:00:00') "
    "WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:00') "
    "END AS parsed FROM texts",
)
def _(spark, d):
    return _date_texts(spark, d).select("event_id", parse_datetime("txt").alias("parsed"))


@query(
    "p05_lenient_number",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN "
    "round(value, 6) WHEN event_type = 'signup' THEN CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) END AS parsed FROM events",
)
def _(spark, d):
    k, v = F.col("event_type"), F.col("value").cast("decimal(18,2)").cast("string")
    text = (
        F.when(k == "click", v)
        .when(k == "view", F.concat(F.lit(" "), v))
        .when(k == "signup", F.get_json_object("props", "$.k"))
        .when(k == "error", F.lit("NaN"))
        .otherwise(F.concat(v, F.lit(" kW")))
    )
    return E.table(spark, d, "events").select("event_id", parse_number(tidy(text)).alias("parsed"))


# ---- projections and filters ---------------------------------------------------


@query("p06_canonical_projection", f"WITH {USER_H} SELECT {LONG} FROM user_h")
def _(spark, d):
    return clean.canonical(E.user_readings(spark, d).withColumn("unit", F.lit("kW")))


@query(
    "p07_column_roles",
    f"SELECT {stamp('ts')} AS datetime, CAST(user_id AS VARCHAR) AS station, {r6('value')} AS target, 0 AS miss_target FROM events",
)
def _(spark, d):
    events = E.table(spark, d, "events")
    loose = events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.col("user_id").alias("station_no"),
        F.col("value").alias("load"),
    )
    return clean.resolve_roles(loose)


@query("p08_required_columns", f"WITH {USER_H} SELECT {LONG} FROM user_h")
def _(spark, d):
    return clean.require_columns(E.user_readings(spark, d), ["datetime", "station", "target"])


@query(
    "p09_drop_null_rows",
    f"WITH {USER_H} SELECT {LONG} FROM user_h WHERE datetime IS NOT NULL AND station IS NOT NULL AND target IS NOT NULL",
)
def _(spark, d):
    return clean.drop_null_rows(E.user_readings(spark, d), ["datetime", "station", "target"])


@query("p10_clean_half", f"WITH {USER_H} SELECT {LONG} FROM user_h WHERE target IS NOT NULL")
def _(spark, d):
    return clean.clean_half(E.user_readings(spark, d))


@query("p10_rejected_half", f"WITH {USER_H} SELECT {LONG} FROM user_h WHERE target IS NULL")
def _(spark, d):
    return clean.rejected_half(E.user_readings(spark, d))


@query(
    "p11_missing_flag",
    f"WITH {USER_H}, {grid_sql('user_h')} SELECT station, {stamp('datetime')} AS datetime, {r6('target')} AS target, "
    "CAST(target IS NULL AS INTEGER) AS miss_target FROM grid",
)
def _(spark, d):
    flagged = grid.flag_missing(grid.regular_grid(E.user_readings(spark, d), HOUR))
    return flagged.select("station", "datetime", "target", "miss_target")


def _ship_facts(spark, d):
    return Q.station_date_facts(E.shipment_readings(spark, d))


SHIP_FACTS = f"{SHIP}, {facts_sql('ship')}, {dates_sql()}, {stations_sql()}"
# Thresholds that separate the synthetic suppliers and days.
RATE, SHARE = 0.33, 0.34
BAD_STATIONS = f"SELECT station FROM by_station WHERE avg_daily_missing_rate > {RATE} OR avg_daily_missing_rate >= 0.999999"
BAD_DATES = f"SELECT date FROM by_date WHERE pct_stations_missing > {SHARE}"


@query("p12_drop_dates", f"WITH {SHIP_FACTS} SELECT {LONG} FROM ship WHERE CAST(datetime AS DATE) NOT IN ({BAD_DATES})")
def _(spark, d):
    return clean.exclude_dates(
        E.shipment_readings(spark, d), clean.bad_dates(Q.date_summary(_ship_facts(spark, d)), SHARE)
    )


@query("p13_drop_stations", f"WITH {SHIP_FACTS} SELECT {LONG} FROM ship WHERE station NOT IN ({BAD_STATIONS})")
def _(spark, d):
    bad = clean.bad_stations(Q.station_summary(_ship_facts(spark, d)), RATE)
    return clean.exclude(E.shipment_readings(spark, d), bad, "station")


@query("p14_bad_stations", f"WITH {SHIP_FACTS} {BAD_STATIONS}")
def _(spark, d):
    return clean.bad_stations(Q.station_summary(_ship_facts(spark, d)), RATE)


@query("p15_bad_dates", f"WITH {SHIP_FACTS} SELECT {day('date')} AS date FROM ({BAD_DATES})")
def _(spark, d):
    return clean.bad_dates(Q.date_summary(_ship_facts(spark, d)), SHARE)


USER_SPARSE = (
    "sparse AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS datetime, CAST(user_id AS VARCHAR) AS station, "
    "CASE WHEN value > 330 THEN value END AS target FROM events)"
)


def _sparse(spark, d):
    return E.readings(
        E.table(spark, d, "events"), "ts", F.col("user_id"), F.when(F.col("value") > 330, F.col("value")), 24 * HOUR
    )


@query(
    "p16_fully_missing_dates",
    f"WITH {USER_SPARSE}, {facts_sql('sparse')}, {dates_sql()}, listed AS (SELECT date FROM by_date WHERE pct_stations_missing = 1.0), "
    "computed AS (SELECT CAST(datetime AS DATE) AS date FROM sparse GROUP BY 1 HAVING count(target) = 0) "
    f"SELECT {day('date')} AS date FROM (SELECT date FROM listed UNION SELECT date FROM computed WHERE NOT EXISTS (SELECT 1 FROM listed))",
)
def _(spark, d):
    r = _sparse(spark, d)
    return clean.fully_missing_dates(Q.date_summary(Q.station_date_facts(r)), Q.empty_dates(r))


@query(
    "p17_candidates",
    f"WITH {SHIP_FACTS} SELECT station, days_reported, {r6('avg_daily_missing_rate')} AS avg_daily_missing_rate, total_missing_points "
    f"FROM by_station WHERE by_station.avg_daily_missing_rate <= {RATE}",
)
def _(spark, d):
    return clean.candidate_stations(Q.station_summary(_ship_facts(spark, d)), RATE)


@query(
    "p18_min_history",
    f"WITH {USER_H} SELECT {LONG} FROM user_h WHERE station IN (SELECT station FROM user_h GROUP BY station HAVING count(target) >= 55)",
)
def _(spark, d):
    return clean.with_min_history(E.user_readings(spark, d), 55)


@query(
    "p22_station_choice",
    f"SELECT {stamp('ts')} AS datetime, CASE WHEN event_type = 'error' THEN 'Zone ' || user_id ELSE event_type END AS station, "
    f"{r6('value')} AS target FROM events",
)
def _(spark, d):
    from gridcast.sources.longwide import station_of

    events = E.table(spark, d, "events")
    named = events.select(
        F.col("ts").alias("datetime"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("station"),
        F.concat(F.lit("file:/data/FY22/Zone%20"), F.col("user_id"), F.lit("%20FY2022_long.csv")).alias("_path"),
        F.col("value").alias("target"),
    )
    return named.select("datetime", station_of(named.columns).alias("station"), "target")


@query("p21_station_from_file_name", "SELECT event_id, 'Zone ' || user_id || ' 66_11kV' AS station FROM events")
def _(spark, d):
    from gridcast.functions.text import station_from_file_name

    events = E.table(spark, d, "events")
    name = F.concat(
        F.lit("Zone "),
        F.col("user_id"),
        F.lit(" 66_11kV"),
        F.when(F.col("event_type") == "click", " FY2022_long.csv")
        .when(F.col("event_type") == "view", " FY2023.csv")
        .when(F.col("event_type") == "error", "_long.csv")
        .otherwise(".csv"),
    )
    return events.select("event_id", station_from_file_name(name).alias("station"))


@query(
    "p23_skip_emptied_stations",
    f"WITH {SHIP_FACTS}, rest AS (SELECT * FROM ship WHERE CAST(datetime AS DATE) NOT IN ({BAD_DATES})), "
    "kept AS (SELECT station FROM rest GROUP BY station HAVING count(target) > 0) "
    f"SELECT {LONG} FROM rest WHERE station IN (SELECT station FROM kept)",
)
def _(spark, d):
    r = E.shipment_readings(spark, d)
    rest = clean.exclude_dates(r, clean.bad_dates(Q.date_summary(Q.station_date_facts(r)), SHARE))
    return clean.without_empty_stations(rest, Q.empty_stations(rest))


@query("p25_rename_target", "SELECT event_id, round(value, 6) AS target FROM events")
def _(spark, d):
    return clean.rename_target(E.table(spark, d, "events"), "value").select("event_id", "target")


# ---- dimension joins -----------------------------------------------------------


@query("w02_station_ids", f"WITH {USER_H}, {ids_sql('user_h')} SELECT station, station_id FROM ids")
def _(spark, d):
    return axis.station_dimension(E.user_readings(spark, d))


@query(
    "j01_attach_station_id",
    f"WITH {USER_H}, {ids_sql('user_h')} SELECT station, {stamp('datetime')} AS datetime, {r6('target')} AS target, station_id "
    "FROM user_h LEFT JOIN ids USING (station)",
)
def _(spark, d):
    r = E.user_readings(spark, d)
    return dims.attach_station_id(r, axis.station_dimension(r))


# Up to two voltage levels per zone, by the kind of its events, so cleaned names repeat.  Zones whose readings never pass 200
# are not in the map of stations: their weather finds no match.
ZONES = (
    "zones AS (SELECT DISTINCT 'Zone ' || user_id || CASE WHEN event_type = 'click' THEN ' 132_11kV' ELSE ' 66_11kV' END AS station "
    "FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 200)), "
    "zone_ids AS (SELECT station, CAST(row_number() OVER (ORDER BY station) - 1 AS INTEGER) AS station_id FROM zones), "
    "cleaned AS (SELECT *, regexp_replace(station, ' [0-9_]+kV$', '') AS station_clean FROM zone_ids)"
)
WEATHER = (
    "weather AS (SELECT 'Zone ' || user_id AS station_clean, CAST(ts AS DATE) AS date, avg(value) AS temperature FROM events GROUP BY 1, 2)"
)


def _zones(spark, d):
    events = E.table(spark, d, "events")
    mapped = events.groupBy("user_id").agg(F.max("value").alias("top")).where(F.col("top") > 200)
    events = events.join(mapped, "user_id", "left_semi")
    tag = F.when(F.col("event_type") == "click", " 132_11kV").otherwise(" 66_11kV")
    return axis.station_dimension(events.select(F.concat(F.lit("Zone "), F.col("user_id"), tag).alias("station")))


@query(
    "j02_weather_station_id",
    f"WITH {ZONES}, {WEATHER}, best AS (SELECT station_clean, max(station_id) AS station_id FROM cleaned GROUP BY 1) "
    f"SELECT w.station_clean, {day('w.date')} AS date, {r6('w.temperature')} AS temperature, CAST(b.station_id AS VARCHAR) AS station_id "
    "FROM weather w LEFT JOIN best b ON b.station_clean = w.station_clean",
)
def _(spark, d):
    matched = dims.attach_weather_station_id(E.daily_weather(spark, d), _zones(spark, d))
    return matched.withColumn("station_id", F.col("station_id").cast("string"))


@query(
    "j03_unmatched_keys",
    f"WITH {ZONES}, {WEATHER} SELECT DISTINCT station_clean FROM weather WHERE station_clean NOT IN (SELECT station_clean FROM cleaned)",
)
def _(spark, d):
    return dims.unmatched_weather(E.daily_weather(spark, d), _zones(spark, d))


@query(
    "j04_duplicate_keys",
    f"WITH {ZONES} SELECT station_clean, station, station_id, count(*) OVER (PARTITION BY station_clean) AS key_rows FROM cleaned "
    "QUALIFY count(*) OVER (PARTITION BY station_clean) > 1",
)
def _(spark, d):
    return dims.ambiguous_stations(_zones(spark, d))


@query("f02_strip_voltage", f"WITH {ZONES} SELECT station, station_clean FROM cleaned")
def _(spark, d):
    return _zones(spark, d).select("station", strip_voltage_tag("station").alias("station_clean"))


@query(
    "j06_exclusion",
    f"WITH {SHIP_FACTS} SELECT {LONG} FROM ship WHERE station NOT IN ({BAD_STATIONS}) AND CAST(datetime AS DATE) NOT IN ({BAD_DATES})",
)
def _(spark, d):
    facts = _ship_facts(spark, d)
    kept = clean.exclude(
        E.shipment_readings(spark, d), clean.bad_stations(Q.station_summary(facts), RATE), "station"
    )
    return clean.exclude_dates(kept, clean.bad_dates(Q.date_summary(facts), SHARE))


# ---- set operations ------------------------------------------------------------

SHIP_COUNTED = f"WITH {SHIP}, {USER_H}"


@query("u01_union_all", f"{SHIP_COUNTED} SELECT {LONG} FROM (SELECT * FROM user_h UNION ALL SELECT * FROM ship)")
def _(spark, d):
    return E.user_readings(spark, d).unionByName(E.shipment_readings(spark, d))


@query(
    "u02_date_intersection",
    f"WITH {SHIP_FACTS} SELECT {day('date')} AS date FROM (SELECT CAST(datetime AS DATE) AS date FROM ship "
    f"WHERE target IS NULL INTERSECT {BAD_DATES})",
)
def _(spark, d):
    r = E.shipment_readings(spark, d)
    missing = r.where(F.col("target").isNull()).select(day_of("datetime").alias("date"))
    return missing.intersect(clean.bad_dates(Q.date_summary(Q.station_date_facts(r)), SHARE))


@query(
    "u03_union_of_reasons",
    f"WITH {SHIP_FACTS} {BAD_STATIONS} UNION SELECT station FROM ship GROUP BY station HAVING count(target) < 100",
)
def _(spark, d):
    r = E.shipment_readings(spark, d)
    by_rate = clean.bad_stations(Q.station_summary(Q.station_date_facts(r)), RATE)
    short = r.groupBy("station").agg(F.count("target").alias("n")).where(F.col("n") < 100).select("station")
    return by_rate.union(short).distinct()


@query(
    "u04_complement",
    f"WITH {USER_H} SELECT {LONG} FROM (SELECT * FROM user_h EXCEPT ALL SELECT * FROM user_h WHERE target IS NOT NULL)",
)
def _(spark, d):
    r = E.user_readings(spark, d)
    return r.exceptAll(clean.clean_half(r)).select("datetime", "station", "target")


# ---- small functions -----------------------------------------------------------


@query("f03_day_floor", f"SELECT event_id, {day('CAST(ts AS DATE)')} AS day FROM events")
def _(spark, d):
    return E.table(spark, d, "events").select("event_id", day_of("ts").alias("day"))


@query("f04_date_format", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(spark, d):
    return E.table(spark, d, "events").select("event_id", iso_day("ts").alias("day"))


@query(
    "f01_clock_names",
    "SELECT event_id, CAST(regexp_matches(txt, '^\\d{2}:\\d{2}$') AS BOOLEAN) AS strict_clock, "
    "regexp_matches(txt, '^\\d{1,2}:\\d{2}$') AS loose_clock FROM (SELECT event_id, CASE event_type "
    "WHEN 'click' THEN strftime(ts, '%H:%M') WHEN 'view' THEN CAST(hour(ts) AS VARCHAR) || ':' || strftime(ts, '%M') "
    "WHEN 'error' THEN strftime(ts, '%H:%M:%S') ELSE event_type END AS txt FROM events)",
)
def _(spark, d):
    from gridcast.functions.text import is_clock

    k = F.col("event_type")
    text = (
        F.when(k == "click", F.date_format("ts", "HH:mm"))
        .when(k == "view", F.date_format("ts", "H:mm"))
        .when(k == "error", F.date_format("ts", "HH:mm:ss"))
        .otherwise(k)
    )
    return E.table(spark, d, "events").select(
        "event_id", is_clock(text, True).alias("strict_clock"), is_clock(text).alias("loose_clock")
    )


@query(
    "f05_text_tests",
    "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, upper(trim(split_part(o_orderpriority, '-', 2))) AS label, "
    "starts_with(o_orderpriority, '1') AS urgent FROM orders",
)
def _(spark, d):
    parts = F.split("o_orderpriority", "-", 2)
    return E.table(spark, d, "orders").select(
        "o_orderkey",
        parts[0].alias("level"),
        F.upper(F.trim(F.element_at(F.split("o_orderpriority", "-"), 2))).alias("label"),
        F.col("o_orderpriority").startswith("1").alias("urgent"),
    )


# ---- whole curation ------------------------------------------------------------

FILTER_RULES = plan.Rules(station_threshold=RATE, date_threshold=SHARE, min_history=1, step_seconds=HOUR, limit=24)


@query(
    "curation_filtered_readings",
    f"WITH {SHIP_FACTS}, kept AS (SELECT * FROM ship WHERE station NOT IN ({BAD_STATIONS}) "
    f"AND CAST(datetime AS DATE) NOT IN ({BAD_DATES})) SELECT {LONG} FROM kept "
    "WHERE station IN (SELECT station FROM kept GROUP BY station HAVING count(target) > 0)",
)
def _(spark, d):
    return plan.filter_readings(E.shipment_readings(spark, d), FILTER_RULES).readings.select("datetime", "station", "target")


@query(
    "curation_dropped_stations",
    f"WITH {SHIP_FACTS}, kept AS (SELECT * FROM ship WHERE station NOT IN ({BAD_STATIONS})), "
    f"dated AS (SELECT * FROM kept WHERE CAST(datetime AS DATE) NOT IN ({BAD_DATES})) "
    f"SELECT station FROM ({BAD_STATIONS} UNION SELECT DISTINCT station FROM kept WHERE station NOT IN "
    "(SELECT station FROM dated GROUP BY station HAVING count(target) > 0))",
)
def _(spark, d):
    return plan.filter_readings(E.shipment_readings(spark, d), FILTER_RULES).dropped_stations


CLEAN_RULES = plan.Rules(min_history=40, step_seconds=HOUR, limit=24)
LIMIT = CLEAN_RULES.limit


@query(
    "curation_clean_table",
    f"WITH {USER_H}, {ids_sql('user_h')}, enough AS (SELECT * FROM user_h WHERE station IN "
    "(SELECT station FROM user_h GROUP BY station HAVING count(target) >= 40)), "
    f"{grid_sql('enough')}, {near_sql('grid')}, "
    f"lim AS (SELECT *, CASE WHEN t - pt <= {LIMIT} OR nt - t <= {LIMIT} THEN {LINEAR} END AS l FROM near), "
    "carried AS (SELECT *, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(l IGNORE NULLS) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM lim), "
    "dated AS (SELECT *, CAST(datetime AS DATE) AS date FROM carried), "
    "present AS (SELECT date FROM dated GROUP BY date HAVING count(target) > 0) "
    f"SELECT {stamp('dated.datetime')} AS datetime, dated.station, ids.station_id, {r6('y')} AS target, "
    f"CAST(dated.target IS NULL AS INTEGER) AS miss_target, {day('dated.date')} AS date FROM dated JOIN ids USING (station) "
    "WHERE dated.date IN (SELECT date FROM present)",
)
def _(spark, d):
    return plan.build_clean(E.user_readings(spark, d), CLEAN_RULES)


# Thresholds that separate the synthetic users and days.
WHOLE_RULES = plan.Rules(station_threshold=0.25, date_threshold=0.45, min_history=40, step_seconds=HOUR, limit=24)


@query(
    "curation_end_to_end",
    f"WITH {USER_H}, {facts_sql('user_h')}, {dates_sql()}, {stations_sql()}, "
    f"bad_s AS (SELECT station FROM by_station WHERE avg_daily_missing_rate > {WHOLE_RULES.station_threshold} OR avg_daily_missing_rate >= 0.999999), "
    f"bad_d AS (SELECT date FROM by_date WHERE pct_stations_missing > {WHOLE_RULES.date_threshold}), "
    "kept AS (SELECT * FROM user_h WHERE station NOT IN (FROM bad_s) AND CAST(datetime AS DATE) NOT IN (FROM bad_d)), "
    "filt AS (SELECT * FROM kept WHERE station IN (SELECT station FROM kept GROUP BY station HAVING count(target) > 0)), "
    f"{ids_sql('filt')}, enough AS (SELECT station FROM filt GROUP BY station HAVING count(target) >= {WHOLE_RULES.min_history}), "
    "w_ext AS (SELECT min(datetime) AS lo, max(datetime) AS hi FROM filt), "
    "w_mean AS (SELECT station, datetime, avg(target) AS target FROM filt GROUP BY station, datetime), "
    "grid AS (SELECT s.station, CAST(date_diff('hour', e.lo, a.datetime) AS BIGINT) AS t, a.datetime, m.target FROM enough s "
    "CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime FROM w_ext) a CROSS JOIN w_ext e "
    "LEFT JOIN w_mean m ON m.station = s.station AND m.datetime = a.datetime), "
    f"{near_sql('grid')}, lim AS (SELECT *, CASE WHEN t - pt <= {LIMIT} OR nt - t <= {LIMIT} THEN {LINEAR} END AS l FROM near), "
    "carried AS (SELECT *, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(l IGNORE NULLS) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y, "
    "CAST(datetime AS DATE) AS date FROM lim), present AS (SELECT date FROM carried GROUP BY date HAVING count(target) > 0) "
    "SELECT c.station, ids.station_id, count(DISTINCT c.date) AS days, count(*) AS points, "
    f"CAST(count(*) FILTER (c.target IS NULL) AS BIGINT) AS missing, {r6('avg(y)')} AS mean, {r6('min(y)')} AS low, {r6('max(y)')} AS high "
    "FROM carried c JOIN ids USING (station) WHERE c.date IN (SELECT date FROM present) GROUP BY c.station, ids.station_id",
)
def _(spark, d):
    table = plan.curate(E.user_readings(spark, d), WHOLE_RULES).clean
    return table.groupBy("station", "station_id").agg(
        F.countDistinct("date").alias("days"),
        F.count(F.lit(1)).alias("points"),
        F.sum(F.col("miss_target").cast("long")).alias("missing"),
        F.avg("target").alias("mean"),
        F.min("target").alias("low"),
        F.max("target").alias("high"),
    )
