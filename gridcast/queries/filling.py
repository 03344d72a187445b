"""Grids, axes and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.times import floor_time
from gridcast.operators import axis, grid, split
from gridcast.operators import fill as fills
from gridcast.queries.base import LINEAR, TYPE_H, USER_H, grid_sql, near_sql, query, r6, stamp
from gridcast.sources import events as E

HOUR = 3600
LIMIT = 6
ROW = f"station, t, {stamp('datetime')} AS datetime"
USER_GRID = f"WITH {USER_H}, {grid_sql('user_h')}"
BACK = "OVER (PARTITION BY station ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "OVER (PARTITION BY station ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
LIM = f"lim AS (SELECT *, CASE WHEN t - pt <= {LIMIT} OR nt - t <= {LIMIT} THEN {LINEAR} END AS l FROM near)"


def user_grid(spark, d, step=HOUR):
    return grid.regular_grid(E.user_readings(spark, d, step), step, carry=True)


def _rows(df):
    return df.select("station", "t", "datetime", "target")


@query("j05_grid_completion", f"{USER_GRID} SELECT {ROW}, {r6('target')} AS target FROM grid")
def _(spark, d):
    return _rows(grid.regular_grid(E.user_readings(spark, d), HOUR))


# Global axis: only datetimes with a value somewhere; every station on every one of them.
SPARSE = (
    "sparse AS (SELECT to_timestamp(CAST(floor(epoch(ts) / 900) * 900 AS BIGINT))::TIMESTAMP AS datetime, event_type AS station, "
    "value AS target FROM events)"
)
AXIS_GRID = (
    f"WITH {SPARSE}, ax AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS t FROM (SELECT DISTINCT datetime FROM sparse)), "
    "m AS (SELECT station, datetime, avg(target) AS target FROM sparse GROUP BY station, datetime), "
    "grid AS (SELECT s.station, ax.t, ax.datetime, m.target FROM (SELECT DISTINCT station FROM sparse) s CROSS JOIN ax "
    "LEFT JOIN m ON m.station = s.station AND m.datetime = ax.datetime)"
)


def quarter_axis(spark, d):
    r = E.type_readings(spark, d, 900)
    return r, axis.time_axis(r)


@query("j05_axis_grid", f"{AXIS_GRID} SELECT station, t, {r6('target')} AS target FROM grid")
def _(spark, d):
    r, ax = quarter_axis(spark, d)
    return grid.axis_grid(r, ax).select("station", "t", "target")


@query("w01_axis_positions", f"{AXIS_GRID} SELECT t, {stamp('ax.datetime')} AS datetime FROM ax")
def _(spark, d):
    return quarter_axis(spark, d)[1]


@query("w03_regular_steps", f"WITH {TYPE_H}, {grid_sql('type_h')} SELECT {ROW} FROM grid")
def _(spark, d):
    return grid.regular_grid(E.type_readings(spark, d), HOUR).select("station", "t", "datetime")


@query(
    "w03_regular_axis",
    f"WITH {TYPE_H}, {grid_sql('type_h')} SELECT DISTINCT t, {stamp('datetime')} AS datetime FROM grid",
)
def _(spark, d):
    return grid.regular_axis(spark, grid.extent_of(E.type_readings(spark, d)), HOUR)


@query("w04_linear_fill", f"{USER_GRID}, {near_sql('grid')} SELECT {ROW}, {r6(LINEAR)} AS target FROM near")
def _(spark, d):
    return _rows(fills.fill_linear(user_grid(spark, d)))


@query(
    "w04_linear_fill_axis",
    f"{AXIS_GRID}, {near_sql('grid')} SELECT station, t, {r6(LINEAR)} AS target FROM near",
)
def _(spark, d):
    r, ax = quarter_axis(spark, d)
    return fills.fill_linear(grid.axis_grid(r, ax, carry=True)).select("station", "t", "target")


@query("w05_limited_fill", f"{USER_GRID}, {near_sql('grid')}, {LIM} SELECT {ROW}, {r6('l')} AS target FROM lim")
def _(spark, d):
    return _rows(fills.fill_limited(user_grid(spark, d), LIMIT))


@query(
    "w06_carried_fill",
    f"{USER_GRID}, {near_sql('grid')}, {LIM}, done AS (SELECT *, coalesce(last_value(l IGNORE NULLS) {BACK}, "
    f"first_value(l IGNORE NULLS) {AHEAD}) AS y FROM lim) SELECT {ROW}, {r6('y')} AS target FROM done",
)
def _(spark, d):
    return _rows(fills.fill_clean(user_grid(spark, d), LIMIT))


# Users whose every value is withheld stay empty after interpolation.
@query(
    "w07_constant_fill",
    "WITH base AS (SELECT date_trunc('hour', ts) AS datetime, CAST(user_id AS VARCHAR) AS station, "
    "CASE WHEN value > 250 THEN value END AS target FROM events), "
    f"{grid_sql('base')}, {near_sql('grid')} SELECT {ROW}, {r6(f'coalesce({LINEAR}, -1.0)')} AS target FROM near",
)
def _(spark, d):
    value = F.when(F.col("value") > 250, F.col("value"))
    r = E.readings(E.table(spark, d, "events"), "ts", F.col("user_id"), value, HOUR)
    return _rows(fills.fill_linear(grid.regular_grid(r, HOUR, carry=True), default=-1.0))


# Every split filled from its own readings.
@query(
    "w04_fill_within_split",
    f"{USER_GRID}, sized AS (SELECT *, max(t) OVER () + 1 AS n FROM grid), "
    "tagged AS (SELECT station AS name, t, datetime, target, CASE WHEN t < CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'a' "
    "WHEN t < CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) + CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) THEN 'b' ELSE 'c' END AS part FROM sized), "
    "keyed AS (SELECT name || '|' || part AS station, name, t, datetime, target FROM tagged), "
    f"{near_sql('keyed')} SELECT name AS station, t, {stamp('datetime')} AS datetime, {r6(LINEAR)} AS target FROM near",
)
def _(spark, d):
    r = E.user_readings(spark, d)
    limits = grid.extent_of(r)
    gridded = grid.regular_grid(r, HOUR, limits=limits, carry=True)
    return _rows(fills.fill_linear(gridded, ranges=split.ratio_ranges(limits.steps(HOUR))))


# The target with two exogenous columns.
EXOG = (
    "ev AS (SELECT date_trunc('hour', ts) AS datetime, event_type AS station, value AS target, "
    "CASE WHEN user_id < 100 THEN value END AS low_users, CASE WHEN value > 60 THEN CAST(user_id AS DOUBLE) END AS who FROM events), "
    "ax AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS t FROM (SELECT DISTINCT datetime FROM ev)), "
)


def _exog_sql(column: str) -> str:
    return (
        f"g_{column} AS (SELECT s.station, ax.t, m.v AS target FROM (SELECT DISTINCT station FROM ev) s CROSS JOIN ax LEFT JOIN "
        f"(SELECT station, datetime, avg({column}) AS v FROM ev GROUP BY 1, 2) m ON m.station = s.station AND m.datetime = ax.datetime), "
        f"{near_sql(f'g_{column}', f'n_{column}')}, f_{column} AS (SELECT station, t, {LINEAR} AS {column} FROM n_{column})"
    )


@query(
    "w04_exogenous_fill",
    f"WITH {EXOG} {_exog_sql('target')}, {_exog_sql('low_users')}, {_exog_sql('who')} "
    f"SELECT station, t, {r6('target')} AS target, {r6('low_users')} AS low_users, {r6('who')} AS who "
    "FROM f_target JOIN f_low_users USING (station, t) JOIN f_who USING (station, t)",
)
def _(spark, d):
    source = E.table(spark, d, "events").select(
        floor_time("ts", HOUR).alias("datetime"),
        F.col("event_type").alias("station"),
        F.col("value").alias("target"),
        F.when(F.col("user_id") < 100, F.col("value")).alias("low_users"),
        F.when(F.col("value") > 60, F.col("user_id").cast("double")).alias("who"),
    )
    return fills.fill_columns(source, axis.time_axis(source), ["target", "low_users", "who"])


BREAKS = (
    f"{AXIS_GRID}, br AS (SELECT t, datetime, CASE WHEN t = 0 THEN 0 "
    "WHEN datetime - lag(datetime) OVER (ORDER BY t) <> INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS is_break FROM ax), "
    "pre AS (SELECT *, CAST(sum(is_break) OVER (ORDER BY t) AS BIGINT) AS breaks FROM br)"
)


@query("w08_break_flags", f"{BREAKS} SELECT t, {stamp('br.datetime')} AS datetime, is_break FROM br")
def _(spark, d):
    return axis.break_flags(quarter_axis(spark, d)[1], 900).select("t", "datetime", "is_break")


@query("w09_break_prefix", f"{BREAKS} SELECT t, breaks FROM pre")
def _(spark, d):
    flags = axis.break_flags(quarter_axis(spark, d)[1], 900)
    return axis.running_total(flags, "t", "is_break", "breaks").select("t", "breaks")


@query(
    "w09_contiguous_starts",
    f"{BREAKS} SELECT a.t FROM pre a JOIN pre b ON b.t = a.t + 11 WHERE b.breaks = a.breaks",
)
def _(spark, d):
    return axis.contiguous_starts(quarter_axis(spark, d)[1], 12, 900)
