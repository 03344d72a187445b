"""Sources and sinks, each as a round trip through files of its own format."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.numbers import round_scaled
from gridcast.functions.text import run_key_column
from gridcast.operators import axis, clean, grid, ragged, windows
from gridcast.operators import quality as Q
from gridcast.plans import forecasting as P
from gridcast.plans import metrics as M
from gridcast.queries.base import (
    SHIP,
    TYPE_H,
    USER_H,
    arr,
    facts_sql,
    grid_sql,
    query,
    r6,
    scratch,
    stamp,
    stations_sql,
)
from gridcast.queries.curation import BAD_STATIONS, LONG, RATE, WIDE, wide_table
from gridcast.queries.forecasts import BUNDLE, ROWS, day_ahead_rows
from gridcast.queries.slicing import (
    FILLED,
    LAST,
    PRED,
    PTS,
    S_SEQ,
    S_TOKEN,
    SEQ,
    filled_hours,
    order_points,
    starts_sql,
    windows_sql,
)
from gridcast.sources import collections as C
from gridcast.sources import events as E
from gridcast.sources import longwide as L
from gridcast.sources import sinks
from gridcast.sources import windows as stored

HOUR = 3600
WIDE_LONG = (
    f"WITH {TYPE_H}, {WIDE} SELECT station, strftime(date + to_hours(h), '%Y-%m-%d %H:%M:%S') AS datetime, {r6('target')} AS target FROM long"
)


def _csv(df, path, mode="overwrite"):
    sinks.write_table(df, path, "csv", mode)
    return path


def _wide_files(spark, d, path):
    return _csv(wide_table(spark, d).withColumnRenamed("station", "Zone Substation"), path)


@query("s01_wide_scan", WIDE_LONG)
def _(spark, d):
    path = _wide_files(spark, d, scratch(spark) + "/wide")
    return L.read_wide(spark, [path], station_from="column").select("station", "datetime", "target")


@query("s02_long_scan", f"WITH {USER_H} SELECT {LONG} FROM user_h")
def _(spark, d):
    path = _csv(E.user_readings(spark, d), scratch(spark) + "/long")
    return L.read_long(spark, [path], pattern="*.csv")


@query("s02_long_scan_pruned", f"WITH {USER_H} SELECT station, count(*) AS rows FROM user_h GROUP BY station")
def _(spark, d):
    path = _csv(E.user_readings(spark, d), scratch(spark) + "/long")
    pruned = L.read_long(spark, [path], pattern="*.csv", columns=["station"])
    return pruned.groupBy("station").agg(F.count(F.lit(1)).alias("rows"))


@query("s03_many_folders_scan", f"WITH {USER_H} SELECT {LONG} FROM user_h")
def _(spark, d):
    base = scratch(spark)
    r = E.user_readings(spark, d)
    early = F.col("datetime") < F.lit("2024-01-15").cast("timestamp_ntz")
    _csv(r.where(early), base + "/FY22")
    _csv(r.where(~early), base + "/FY23")
    return L.read_long(spark, [base + "/FY22", base + "/FY23", base + "/FY24"], pattern="*.csv")


@query("s04_recursive_scan", WIDE_LONG)
def _(spark, d):
    base = scratch(spark)
    _wide_files(spark, d, base + "/year/zone/wide")
    return L.read_wide(spark, [base + "/year"], station_from="column", recursive=True).select("station", "datetime", "target")


@query(
    "s05_format_dispatch",
    f"WITH {TYPE_H}, {USER_H}, {WIDE} SELECT {stamp('datetime')} AS datetime, station, {r6('target')} AS target FROM "
    "(SELECT date + to_hours(h) AS datetime, station, target FROM long UNION ALL SELECT * FROM user_h)",
)
def _(spark, d):
    base = scratch(spark)
    _csv(wide_table(spark, d), base + "/in/wide")
    _csv(E.user_readings(spark, d), base + "/in/long")
    return L.scan(spark, [base + "/in"], recursive=True).readings


@query(
    "s06_quarantine",
    "SELECT 'unreadable rows' AS reason, count(*) FILTER (event_type = 'error') AS rows FROM events "
    "UNION ALL SELECT 'unrecognised columns', 0",
)
def _(spark, d):
    base = scratch(spark)
    r = E.type_readings(spark, d)
    # Those of the first hour go to wide files, as lines with a field too few or too many.
    early = (F.col("station") == "error") & (F.hour("datetime") == 0)
    short = F.when(F.dayofmonth("datetime") % 2 == 0, "02JAN2024,1").otherwise("02JAN2024,1,2,3")
    whole = spark.range(4).select(F.col("id").alias("file"), F.posexplode(F.array(F.lit("Date,00:00,00:30"), F.lit("01JAN2024,1,2"))).alias("n", "value"))
    broken = r.where(early).select(F.pmod(F.dayofmonth("datetime"), F.lit(4)).cast("long").alias("file"), F.lit(2).alias("n"), short.alias("value"))
    lines = whole.unionByName(broken).repartition("file").sortWithinPartitions("file", "n")
    lines.select("file", "value").write.partitionBy("file").text(base + "/in/wide")
    r = r.where(~early).withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    broken = F.when(F.col("station") == "error", "not a time").otherwise(F.col("datetime"))
    _csv(r.withColumn("datetime", broken), base + "/in/long")
    _csv(E.table(spark, d, "region"), base + "/in/other")
    rejects = L.scan(spark, [base + "/in"], "part-*", recursive=True).rejects
    return rejects.groupBy("reason").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


# ---- collections ---------------------------------------------------------------

TSF_ROWS = f"WITH {TYPE_H}, {grid_sql('type_h')}"


def _tsf_lines(spark, d):
    """One data line per station from the hourly grid; a gap is ``?``."""
    gridded = grid.regular_grid(E.type_readings(spark, d), HOUR)
    blocks = windows.series_blocks(gridded, 0, block_points=24)
    cell = F.transform("points", lambda v: F.coalesce(round_scaled(v, 4).cast("string"), F.lit("?")))
    return blocks.select(
        F.concat_ws(
            ":",
            F.concat(F.col("station"), F.lit("_"), F.col("part")),
            F.lit("2024-01-01 00-00-00"),
            F.array_join(cell, ","),
        ).alias("value")
    )


@query(
    "s07_tsf_scan",
    f"{TSF_ROWS}, lines AS (SELECT station || '_' || (t // 24) AS series_name, list(round(target, 4) ORDER BY t) AS w FROM grid GROUP BY station, t // 24) "
    "SELECT series_name, '2024-01-01 00:00:00' AS start_timestamp, "
    f"{arr('w')} AS series_value FROM lines WHERE len(list_filter(w, lambda v: v IS NOT NULL)) > 0",
)
def _(spark, d):
    path = scratch(spark) + "/tsf"
    header = spark.createDataFrame(
        [("@relation hours\n@attribute series_name string\n@attribute start_timestamp date\n@frequency hourly\n@horizon 24\n"
          "@missing true\n@equallength true\n@data\n# one line per day",)],
        "value string",
    )
    header.write.mode("append").text(path)
    _tsf_lines(spark, d).write.mode("append").text(path)
    return C.read_tsf(spark, path).series


@query(
    "s08_channel_scan",
    f"{TSF_ROWS} SELECT station AS channel, {stamp('datetime')} AS datetime, {r6('target')} AS value FROM grid",
)
def _(spark, d):
    gridded = grid.regular_grid(E.type_readings(spark, d), HOUR)
    # They are the columns of the wide file.
    names = sorted(r["station"] for r in gridded.select("station").distinct().toLocalIterator())
    wide = gridded.groupBy("datetime").pivot("station", names).agg(F.first("target"))
    path = _csv(wide, scratch(spark) + "/channels")
    return C.read_channels(spark, path).select("channel", "datetime", "value")


@query(
    "s09_matrix_scan",
    "SELECT vec_id AS vec, CAST(unnest(range(64)) AS INTEGER) AS channel, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings",
)
def _(spark, d):
    path = scratch(spark) + "/matrix"
    vectors = E.embedding_marks(spark, d).repartitionByRange("t").sortWithinPartitions("t")
    cells = F.concat(F.array(F.col("t").cast("string")), F.transform("emb", lambda v: v.cast("double").cast("string")))
    vectors.select(F.array_join(cells, ",").alias("value")).write.text(path)
    rows = C.read_matrix(spark, path)
    # The first column repeats the row's id, which shows that lines kept their numbers.
    first = rows.where(F.col("channel") == 0).select("path", "t", F.col("value").cast("long").alias("vec"))
    base = first.groupBy("path").agg(F.min("vec").alias("low"))
    checked = first.join(base, "path").where(F.col("vec") - F.col("low") == F.col("t"))
    return (
        rows.where(F.col("channel") > 0)
        .join(checked.select("path", "t", "vec"), ["path", "t"])
        .select("vec", (F.col("channel") - 1).alias("channel"), "value")
    )


@query(
    "s10_group_scan",
    f"WITH {PTS}, {LAST}, g AS (SELECT w.series AS id, CASE WHEN l.n < 9 THEN 'Yearly' ELSE 'Monthly' END AS grp, w.x FROM last_w w JOIN lens l USING (series)) "
    f"SELECT id, grp, {arr('x')} AS series FROM g WHERE grp = 'Yearly'",
)
def _(spark, d):
    points = order_points(spark, d)
    grouped = ragged.last_window(points, S_SEQ).join(ragged.lengths(points), ragged.KEY)
    table = grouped.select(
        F.col(ragged.KEY).alias("id"),
        F.when(F.col("n") < 9, "Yearly").otherwise("Monthly").alias("grp"),
        F.col("x").alias("series"),
    )
    path = scratch(spark) + "/groups"
    sinks.write_table(table, path, by=["grp"])
    return C.read_group(spark, path, "Yearly")


# ---- windows and marks ---------------------------------------------------------

PRECUT = (
    f"{FILLED}, bounds AS (SELECT 'all' AS split, 0 AS b1, n AS b2 FROM size), {starts_sql()}, {windows_sql(label=0)}, "
    "ids AS (SELECT station, CAST(row_number() OVER (ORDER BY station) - 1 AS INTEGER) AS station_id FROM (SELECT DISTINCT station FROM filled))"
)


def _stored_windows(spark, d):
    df, n = filled_hours(spark, d)
    stations = axis.station_dimension(E.type_readings(spark, d))
    pairs = windows.precut_pairs(df, SEQ, PRED, n).join(stations, "station")
    path = scratch(spark) + "/windows"
    sinks.write_windows(pairs.select("station_id", "s_begin", "x", "y"), path)
    return path


@query("s16_window_sink", f"WITH {PRECUT} SELECT ids.station_id, s_begin, len(x) AS nx, len(y) AS ny FROM win JOIN ids USING (station)")
def _(spark, d):
    pairs = stored.read_windows(spark, _stored_windows(spark, d))
    return pairs.select(
        "station_id", "s_begin", F.size("x").cast("long").alias("nx"), F.size("y").cast("long").alias("ny")
    )


@query(
    "s11_window_scan",
    f"WITH {PRECUT} SELECT count(*) AS samples, CAST(0 AS BIGINT) AS bad_x, CAST(0 AS BIGINT) AS bad_y, CAST(0 AS BIGINT) AS bad_station FROM win",
)
def _(spark, d):
    return windows.unequal_lengths(stored.read_windows(spark, _stored_windows(spark, d), check=True))


@query(
    "s17_mark_sink",
    f"SELECT vec_id AS t, {arr('embedding')} AS emb FROM embeddings",
)
def _(spark, d):
    path = scratch(spark) + "/marks"
    sinks.write_marks(E.embedding_marks(spark, d), path)
    return stored.read_marks(spark, path).select("t", "emb")


# ---- other sinks ---------------------------------------------------------------


@query("s13_table_sink", f"WITH {USER_H} SELECT {LONG} FROM user_h")
def _(spark, d):
    path = scratch(spark) + "/table"
    sinks.write_sorted(E.user_readings(spark, d), path)
    return spark.read.parquet(path)


@query("s14_append_sink", f"WITH {TYPE_H}, {USER_H} SELECT {LONG} FROM (SELECT * FROM type_h UNION ALL SELECT * FROM user_h)")
def _(spark, d):
    path = scratch(spark) + "/merged"
    sinks.append_readings(E.type_readings(spark, d), path)
    sinks.append_readings(E.user_readings(spark, d), path)
    return L.read_long(spark, [path], pattern="*.csv")


@query("s14_append_once", f"WITH {TYPE_H}, {USER_H} SELECT {LONG} FROM (SELECT * FROM type_h UNION ALL SELECT * FROM user_h)")
def _(spark, d):
    path = scratch(spark) + "/batches"
    sinks.append_batch(E.type_readings(spark, d), path, "types")
    # An attempt that failed before it was committed, and repeats of both.
    sinks.write_table(E.user_readings(spark, d).limit(10), f"{path}/batch=users")
    for _attempt in range(2):
        sinks.append_batch(E.user_readings(spark, d), path, "users")
        sinks.append_batch(E.type_readings(spark, d), path, "types")
    return sinks.read_batches(spark, path, "datetime timestamp_ntz, station string, target double")


@query("s15_partitioned_sink", f"WITH {TYPE_H} SELECT CAST(year(datetime) AS INTEGER) AS fy, station, count(*) AS rows, {r6('sum(target)')} AS total FROM type_h GROUP BY ALL")
def _(spark, d):
    path = scratch(spark) + "/by_station"
    sinks.write_by_year_and_station(E.type_readings(spark, d), path, fmt="parquet")
    return spark.read.parquet(path).groupBy("fy", "station").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("target").alias("total")
    )


@query(
    "s18_wide_forecast",
    f"WITH {PTS}, {LAST} SELECT series AS id, round(x[{S_SEQ - 1}], 6) AS V1, round(x[{S_SEQ}], 6) AS V2 FROM last_w",
)
def _(spark, d):
    last = ragged.last_window(order_points(spark, d), S_SEQ)
    out = P.rollout(last, P.forecaster("last_token", S_TOKEN), S_TOKEN, S_TOKEN)
    path = scratch(spark)
    sinks.write_forecasts(out.select(F.col(ragged.KEY).alias("id"), "forecast"), S_TOKEN, "Yearly", path)
    return spark.read.schema("id bigint, V1 double, V2 double").option("header", True).csv(f"{path}/Yearly_forecast")


MEASURES = ["mae", "mse", "rmse", "mape", "mspe"]
SETTINGS = {"hours_": "seasonal", "sl": SEQ, "pl": PRED, "run": 0}


@query(
    "s19_metric_log",
    f"WITH {ROWS}, b AS (SELECT {BUNDLE} FROM fr) "
    + " UNION ALL ".join(
        f"SELECT 'hours_seasonal_sl{SEQ}_pl{PRED}_run{i}' AS run_key, '{m}' AS metric, {m} AS value FROM b" for i in (0, 1) for m in MEASURES
    ),
)
def _(spark, d):
    path = scratch(spark) + "/log"
    for repeat in (0, 1):
        sinks.log_metrics(M.bundle(day_ahead_rows(spark, d)).select(*MEASURES), {**SETTINGS, "run": repeat}, path)
    return sinks.read_metrics(spark, path)


@query("s20_dropped_list_sink", f"WITH {SHIP}, {facts_sql('ship')}, {stations_sql()} {BAD_STATIONS}")
def _(spark, d):
    path = scratch(spark) + "/dropped"
    facts = Q.station_date_facts(E.shipment_readings(spark, d))
    sinks.write_key_list(clean.bad_stations(Q.station_summary(facts), RATE), "station", path)
    return spark.read.schema("station string").option("header", True).csv(path)


@query(
    "s21_run_key",
    "SELECT DISTINCT 'data' || event_type || '_sl48_user' || user_id AS run_key FROM events",
)
def _(spark, d):
    events = E.table(spark, d, "events").select("event_type", "user_id").distinct()
    key = run_key_column({"data": F.col("event_type"), "sl": F.lit(SEQ), "user": F.col("user_id")})
    return events.select(key.alias("run_key"))
