"""Registry, shared inputs and an engine-neutral rendering of results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    ByteType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    ShortType,
    TimestampNTZType,
    TimestampType,
)

from gridcast.functions.vectors import fixed_point

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: render(fn(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def render(df: DataFrame) -> DataFrame:
    """Days and times as text, doubles to six places, arrays as fixed-point text."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (TimestampNTZType, TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (DoubleType, FloatType, DecimalType)):
            c = F.round(c.cast("double") * 1e6, 0) / 1e6
        elif isinstance(kind, (ByteType, ShortType)):
            c = c.cast("int")
        elif isinstance(kind, ArrayType):
            flat = F.flatten(c) if isinstance(kind.elementType, ArrayType) else c
            c = fixed_point(flat)
        out.append(c.alias(field.name))
    return df.select(*out)


# ---- the same renderings in SQL ------------------------------------------------


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def arr(x: str) -> str:
    return (
        f"array_to_string(list_transform({x}, lambda v: "
        "coalesce(CAST(CAST(round(CAST(v AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR), 'null')), ',')"
    )


# ---- shared inputs in SQL ------------------------------------------------------

TYPE_H = "type_h AS (SELECT date_trunc('hour', ts) AS datetime, event_type AS station, value AS target FROM events)"
USER_H = (
    "user_h AS (SELECT date_trunc('hour', ts) AS datetime, CAST(user_id AS VARCHAR) AS station, "
    "CASE WHEN event_type <> 'error' THEN value END AS target FROM events)"
)
SHIP = (
    "ship AS (SELECT CAST(l_shipdate AS TIMESTAMP) AS datetime, CAST(l_suppkey AS VARCHAR) AS station, "
    "CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS target FROM lineitem)"
)


def grid_sql(source: str, step: str = "hour", name: str = "grid") -> str:
    """Regular grid of a source as a CTE list: duplicates averaged, gaps NULL."""
    return (
        f"{name}_ext AS (SELECT min(datetime) AS lo, max(datetime) AS hi FROM {source}), "
        f"{name}_axis AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 {step})) AS datetime FROM {name}_ext), "
        f"{name}_mean AS (SELECT station, datetime, avg(target) AS target FROM {source} GROUP BY station, datetime), "
        f"{name} AS (SELECT s.station, CAST(date_diff('{step}', e.lo, a.datetime) AS BIGINT) AS t, a.datetime, m.target "
        f"FROM (SELECT DISTINCT station FROM {source}) s CROSS JOIN {name}_axis a CROSS JOIN {name}_ext e "
        f"LEFT JOIN {name}_mean m ON m.station = s.station AND m.datetime = a.datetime)"
    )


def near_sql(source: str, name: str = "near") -> str:
    """Adds the closest readings before and after each row of a grid."""
    back = "OVER (PARTITION BY station ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY station ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    has_t = "CASE WHEN target IS NOT NULL THEN t END"
    return (
        f"{name} AS (SELECT *, last_value({has_t} IGNORE NULLS) {back} AS pt, last_value(target IGNORE NULLS) {back} AS py, "
        f"first_value({has_t} IGNORE NULLS) {ahead} AS nt, first_value(target IGNORE NULLS) {ahead} AS ny FROM {source})"
    )


LINEAR = (
    "CASE WHEN target IS NOT NULL THEN target WHEN pt IS NULL THEN ny WHEN nt IS NULL THEN py "
    "ELSE py + (ny - py) * (t - pt) / (nt - pt) END"
)


def filled_sql(source: str, name: str = "filled") -> str:
    """Unlimited interpolation of a grid, ready for windows."""
    return f"{near_sql(source, name + '_near')}, {name} AS (SELECT station, t, datetime, {LINEAR} AS target FROM {name}_near)"


FACTS_COLUMNS = (
    "count(*) AS total_points, count(*) FILTER (target IS NULL) AS orig_missing, "
    "CAST(count(*) FILTER (target IS NULL) AS DOUBLE) / count(*) AS orig_missing_rate"
)


def facts_sql(source: str, name: str = "facts") -> str:
    return (
        f"{name} AS (SELECT station, CAST(datetime AS DATE) AS date, {FACTS_COLUMNS} FROM {source} "
        f"GROUP BY station, CAST(datetime AS DATE))"
    )


def dates_sql(facts: str = "facts", name: str = "by_date") -> str:
    return (
        f"{name} AS (SELECT date, count(*) FILTER (orig_missing > 0) AS stations_with_missing, "
        f"CAST(sum(orig_missing) AS BIGINT) AS total_missing_points, count(DISTINCT station) AS stations_reported, "
        f"CAST(count(*) FILTER (orig_missing > 0) AS DOUBLE) / count(DISTINCT station) AS pct_stations_missing "
        f"FROM {facts} GROUP BY date)"
    )


def stations_sql(facts: str = "facts", name: str = "by_station") -> str:
    return (
        f"{name} AS (SELECT station, count(DISTINCT date) AS days_reported, avg(orig_missing_rate) AS avg_daily_missing_rate, "
        f"CAST(sum(orig_missing) AS BIGINT) AS total_missing_points FROM {facts} GROUP BY station)"
    )


def ids_sql(source: str, name: str = "ids") -> str:
    return (
        f"{name} AS (SELECT station, CAST(row_number() OVER (ORDER BY station) - 1 AS INTEGER) AS station_id "
        f"FROM (SELECT DISTINCT station FROM {source}))"
    )


def scratch(spark: SparkSession) -> str:
    """A new folder for a round trip: in the cluster's shared folder, or else in the session's warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/round-trip-{uuid.uuid4().hex}"
