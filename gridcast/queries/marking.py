"""Mark vectors: checks, lookups, prompts, pooling, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions import vectors as V
from gridcast.operators import axis, grid, marks, split, windows
from gridcast.plans import dataset
from gridcast.plans import forecasting as P
from gridcast.queries.base import arr, filled_sql, query, r6, scratch
from gridcast.queries.slicing import (
    EVERY_WINDOW,
    HOUR,
    LABEL,
    N_TRAIN,
    PRED,
    SEQ,
    TOKEN,
    bounds_sql,
    every_window,
    starts_sql,
    windows_sql,
)
from gridcast.sources import events as E
from gridcast.sources import sinks
from gridcast.staging import settle

MARK_DIM = 64


def hour_axis(spark, d):
    return grid.regular_axis(spark, grid.extent_of(E.type_readings(spark, d)), HOUR)


def axis_marks(spark, d):
    """A vector for every hour of the axis: the embedding table repeats along it."""
    vectors = E.embedding_marks(spark, d)
    ax = hour_axis(spark, d)
    n = vectors.agg(F.count(F.lit(1))).scalar()
    return ax.withColumn("_n", n).withColumn("_v", F.col("t") % F.col("_n")).join(
        vectors.select(F.col("t").alias("_v"), "emb"), "_v"
    ).select("t", "emb")


def station_marks(spark, d):
    """Per-station weather vectors: the same table, shifted by station."""
    r = E.type_readings(spark, d)
    stations = axis.station_dimension(r)
    vectors = E.embedding_marks(spark, d)
    n_steps = grid.extent_of(r).steps(HOUR)
    n = vectors.agg(F.count(F.lit(1))).scalar()
    slots = stations.select(
        "station", "station_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_steps - 1).cast("long"))).alias("t")
    ).withColumn("_n", n)
    slots = slots.withColumn("_v", (F.col("t") + 7 * (F.col("station_id") + 1)) % F.col("_n"))
    return slots.join(vectors.select(F.col("t").alias("_v"), "emb"), "_v").select("station", "t", "emb")


VEC = (
    "vecs AS (SELECT vec_id, embedding AS emb, count(*) OVER () AS nv FROM embeddings), "
    "marks AS (SELECT ax.t, v.emb FROM (SELECT DISTINCT t FROM filled) ax JOIN vecs v ON v.vec_id = ax.t % v.nv), "
    "sids AS (SELECT station, row_number() OVER (ORDER BY station) - 1 AS sid FROM (SELECT DISTINCT station FROM filled)), "
    "wmarks AS (SELECT f.station, f.t, v.emb FROM filled f JOIN sids USING (station) JOIN vecs v ON v.vec_id = (f.t + 7 * (sid + 1)) % v.nv)"
)


def pick_sql(table: str, lo: str, n: int, keyed: bool = False) -> str:
    """Flattened marks of every token from position ``lo`` over ``n`` points."""
    station = f" AND k.station = w.station" if keyed else ""
    return (
        f"(SELECT flatten(list(k.emb ORDER BY k.t)) FROM {table} k WHERE k.t >= {lo} AND k.t < {lo} + {n} "
        f"AND (k.t - ({lo})) % {TOKEN} = 0{station})"
    )


MARKED = (
    f"{EVERY_WINDOW}, {VEC}, mw AS (SELECT w.*, {pick_sql('marks', 'w.s_begin', SEQ)} AS x_mark, "
    f"{pick_sql('marks', f'w.s_begin + {SEQ}', PRED)} AS y_mark FROM tw w)"
)


def marked_windows(spark, d):
    return marks.attach_marks(every_window(spark, d), axis_marks(spark, d), SEQ, LABEL, PRED, TOKEN)


@query(
    "f06_span_prompts",
    "WITH ax AS (SELECT DISTINCT date_trunc('hour', ts) AS dt FROM events) SELECT row_number() OVER (ORDER BY dt) - 1 AS t, "
    f"'This is Time Series from ' || strftime(dt, '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(dt + INTERVAL {TOKEN - 1} HOUR, '%Y-%m-%d %H:%M:%S') || '.' AS prompt FROM ax",
)
def _(spark, d):
    return marks.prompts(axis.time_axis(E.type_readings(spark, d)), TOKEN, 60)


@query(
    "s12_mark_scan_check",
    "WITH ax AS (SELECT date_diff('hour', min(ts), max(ts)) + 1 AS n FROM events) SELECT n AS least_marked, n AS most_marked, "
    "n AS axis_points, CAST(0 AS BIGINT) AS outside, true AS ok FROM ax",
)
def _(spark, d):
    return marks.check_marks(axis_marks(spark, d), hour_axis(spark, d))


@query(
    "s12_station_mark_check",
    "WITH ax AS (SELECT date_diff('hour', min(ts), max(ts)) + 1 AS n FROM events) SELECT n AS least_marked, n AS most_marked, "
    "n AS axis_points, CAST(0 AS BIGINT) AS outside, true AS ok FROM ax",
)
def _(spark, d):
    stations = E.type_readings(spark, d).select("station").distinct()
    return marks.check_marks(station_marks(spark, d), hour_axis(spark, d), ["station"], stations)


@query(
    "s17_stored_blocks",
    f"WITH {EVERY_WINDOW}, {VEC} SELECT w.station, w.split, w.s_begin, {arr(pick_sql('wmarks', 'w.s_begin', SEQ, True))} AS x_mark, "
    f"{arr(pick_sql('wmarks', f'w.s_begin + {SEQ}', PRED, True))} AS y_mark FROM tw w",
)
def _(spark, d):
    """Windows and marks stored in buckets of station and block, which join where they lie."""
    return stored_block_windows(spark, d)


def stored_block_windows(spark, d):
    base = scratch(spark)
    r = E.type_readings(spark, d)
    n = grid.extent_of(r).steps(HOUR)
    index = windows.windows_index(r.select("station").distinct().withColumn("n", F.lit(n)), SEQ + PRED, split.ratio_ranges(n))
    placed = marks.mark_positions(index, SEQ, LABEL, PRED, TOKEN).withColumn("part", F.floor(F.col("s_begin") / marks.MARK_BLOCK).cast("long"))
    held = marks.mark_blocks(station_marks(spark, d), SEQ + PRED - 1, ["station"])
    sinks.write_blocks(placed, base + "/placed")
    sinks.write_blocks(held, base + "/marks")
    return marks.marks_of_blocks(*[sinks.read_blocks(spark, base + path, df.schema) for path, df in (("/placed", placed), ("/marks", held))])


@query(
    "w20_mark_positions",
    f"WITH {EVERY_WINDOW} SELECT station, s_begin, array_to_string(list_transform(range({SEQ // TOKEN}), lambda i: "
    f"CAST((s_begin + i * {TOKEN}) * 10000 AS VARCHAR)), ',') AS x_pos, array_to_string(list_transform(range({PRED // TOKEN}), "
    f"lambda i: CAST((s_begin + {SEQ} + i * {TOKEN}) * 10000 AS VARCHAR)), ',') AS y_pos FROM tw",
)
def _(spark, d):
    index = every_window(spark, d).select("station", "s_begin")
    return marks.mark_positions(index, SEQ, LABEL, PRED, TOKEN)


@query(
    "j08_time_marks",
    f"WITH {MARKED} SELECT station, s_begin, {arr('x_mark')} AS x_mark, {arr('y_mark')} AS y_mark FROM mw",
)
def _(spark, d):
    return marked_windows(spark, d).select("station", "s_begin", "x_mark", "y_mark")


BOTH = (
    f"{EVERY_WINDOW}, {VEC}, bw AS (SELECT w.station, w.s_begin, list_transform(range({SEQ // TOKEN}), lambda i: w.s_begin + i * {TOKEN}) AS pos FROM tw w), "
    "ex AS (SELECT station, s_begin, unnest(pos) AS t FROM bw), "
    "je AS (SELECT ex.station, ex.s_begin, ex.t, list_concat(m.emb, k.emb) AS emb FROM ex JOIN marks m ON m.t = ex.t "
    "JOIN wmarks k ON k.station = ex.station AND k.t = ex.t)"
)


@query(
    "j09_time_and_weather_marks",
    f"WITH {BOTH} SELECT station, s_begin, {arr('flatten(list(emb ORDER BY t))')} AS x_mark FROM je GROUP BY station, s_begin",
)
def _(spark, d):
    return both_marks(spark, d).select("station", "s_begin", "x_mark")


def both_marks(spark, d):
    timed = marked_windows(spark, d)
    weather = marks.attach_marks(
        timed, station_marks(spark, d), SEQ, LABEL, PRED, TOKEN, keys=["station"], names=("_wx", "_wy")
    )
    return weather.withColumn("x_mark", marks.join_marks(F.col("x_mark"), F.col("_wx"))).withColumn(
        "y_mark", marks.join_marks(F.col("y_mark"), F.col("_wy"))
    ).drop("_wx", "_wy")


@query(
    "w27_future_mark_feed",
    f"WITH {MARKED} SELECT station, s_begin, {arr(f'list_concat(x_mark[{MARK_DIM + 1}:], y_mark[1:{MARK_DIM}])')} AS x_mark FROM mw",
)
def _(spark, d):
    w = marked_windows(spark, d)
    return w.select("station", "s_begin", marks.feed_future_mark(F.col("x_mark"), F.col("y_mark"), 1).alias("x_mark"))


# ---- the whole dataset of many stations in one query -----------------------------

Q_SEQ, Q_LABEL, Q_PRED, Q_TOKEN, QUARTER = 16, 8, 8, 8, 900
MANY = (
    "sparse AS (SELECT to_timestamp(CAST(floor(epoch(ts) / 900) * 900 AS BIGINT))::TIMESTAMP AS datetime, event_type AS station, value AS target FROM events), "
    "ax AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS t FROM (SELECT DISTINCT datetime FROM sparse)), "
    "m_mean AS (SELECT station, datetime, avg(target) AS target FROM sparse GROUP BY station, datetime), "
    "m_grid AS (SELECT s.station, CAST(ax.t AS BIGINT) AS t, ax.datetime, m.target FROM (SELECT DISTINCT station FROM sparse) s CROSS JOIN ax "
    "LEFT JOIN m_mean m ON m.station = s.station AND m.datetime = ax.datetime), "
    f"{filled_sql('m_grid', 'raw')}, size AS (SELECT count(*) AS n FROM ax), "
    f"par AS (SELECT station, avg(target) AS mu, greatest(stddev_pop(target), 1e-6) AS sd FROM raw, size WHERE t < {N_TRAIN} GROUP BY station), "
    "filled AS (SELECT r.station, r.t, (r.target - p.mu) / p.sd AS target FROM raw r JOIN par p USING (station)), "
    "br AS (SELECT t, CASE WHEN t > 0 AND datetime - lag(datetime) OVER (ORDER BY t) <> INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS b FROM ax), "
    "pre AS (SELECT t, sum(b) OVER (ORDER BY t) AS p FROM br), "
    f"ok AS (SELECT a.t FROM pre a JOIN pre z ON z.t = a.t + {Q_SEQ + Q_PRED - 1} WHERE a.p = z.p), "
    f"{bounds_sql()}, {starts_sql(Q_SEQ + Q_PRED, name='all_starts')}, starts AS (SELECT s.* FROM all_starts s JOIN ok ON ok.t = s.s_begin), "
    f"{windows_sql(Q_SEQ, Q_LABEL, Q_PRED)}, {VEC}"
)


def _both_sql(lo: str, n: int) -> str:
    """Marks of the axis with the station's own appended, token by token, in one list."""
    return (
        "(SELECT flatten(list(list_concat(m.emb, k.emb) ORDER BY m.t)) FROM marks m JOIN wmarks k ON k.t = m.t AND k.station = w.station "
        f"WHERE m.t >= {lo} AND m.t < {lo} + {n} AND (m.t - ({lo})) % {Q_TOKEN} = 0)"
    )


@query(
    "multistation_windows",
    f"WITH {MANY} SELECT station, split, s_begin, {arr('list_transform(x, lambda q: round(q, 9))')} AS x, {arr('list_transform(y, lambda q: round(q, 9))')} AS y, "
    f"{arr(_both_sql('w.s_begin', Q_SEQ))} AS x_mark, {arr(_both_sql(f'w.s_begin + {Q_SEQ}', Q_PRED))} AS y_mark FROM win w",
)
def _(spark, d):
    r = E.type_readings(spark, d, QUARTER)
    ax = settle(axis.time_axis(r))
    vectors = E.embedding_marks(spark, d)
    n = vectors.agg(F.count(F.lit(1))).scalar()
    of = vectors.select(F.col("t").alias("_v"), "emb")
    timed = ax.select("t", n.alias("_n")).withColumn("_v", F.col("t") % F.col("_n")).join(of, "_v").select("t", "emb")
    stations = axis.station_dimension(r).select("station", "station_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.axis_length(ax) - 1).cast("long"))).alias("t"))
    slots = stations.withColumn("_n", n)
    own = slots.withColumn("_v", (F.col("t") + 7 * (F.col("station_id") + 1)) % F.col("_n")).join(of, "_v").select("station", "t", "emb")
    out = dataset.multistation_windows(r, timed, own, Q_SEQ, Q_LABEL, Q_PRED, Q_TOKEN, QUARTER, ax)
    # The noise of sums in another order must not decide how a half is rounded in the digest.
    return out.withColumns({c: F.transform(c, lambda v: F.round(v, 9)) for c in ("x", "y")})


NORM = "sqrt(list_sum(list_transform({v}, lambda q: CAST(q AS DOUBLE) * CAST(q AS DOUBLE))))"


@query(
    "f13_unit_vectors",
    f"WITH v AS (SELECT vec_id, embedding AS e, {NORM.format(v='embedding')} AS n FROM embeddings) "
    f"SELECT vec_id, {arr('list_transform(e, lambda q: CAST(q AS DOUBLE) / n)')} AS unit FROM v",
)
def _(spark, d):
    vectors = E.embedding_marks(spark, d)
    return vectors.select(F.col("t").alias("vec_id"), V.unit(F.col("emb")).alias("unit"))


@query(
    "f14_mix_vectors",
    f"WITH v AS (SELECT vec_id, embedding AS e, {NORM.format(v='embedding')} AS n, count(*) OVER () AS nv FROM embeddings) "
    f"SELECT a.vec_id, {arr('list_transform(range(1, len(a.e) + 1), lambda i: CAST(a.e[i] AS DOUBLE) / a.n + 0.3 * (CAST(b.e[i] AS DOUBLE) / b.n))')} AS mixed "
    "FROM v a JOIN v b ON b.vec_id = (a.vec_id + 1) % a.nv",
)
def _(spark, d):
    vectors = E.embedding_marks(spark, d)
    n = vectors.agg(F.count(F.lit(1))).scalar()
    nxt = vectors.select(F.col("t").alias("_t"), F.col("emb").alias("_e"))
    joined = vectors.withColumn("_n", n).withColumn("_t", (F.col("t") + 1) % F.col("_n")).join(nxt, "_t")
    return joined.select(F.col("t").alias("vec_id"), V.mix(F.col("emb"), F.col("_e"), 0.3).alias("mixed"))


# Token vectors pooled per label; tokens of even id are masked out as padding.
@query(
    "a22_masked_mean",
    "WITH flat AS (SELECT label, CASE WHEN embedding[1] > 0 THEN 1.0 ELSE 0.0 END AS m, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM embeddings), "
    "p AS (SELECT label, dim, sum(CAST(v AS DOUBLE) * m) / greatest(sum(m), 1e-6) AS v FROM flat GROUP BY label, dim) "
    f"SELECT label, {arr('list(v ORDER BY dim)')} AS emb FROM p GROUP BY label",
)
def _(spark, d):
    tokens = E.table(spark, d, "embeddings").select(
        "label", F.col("embedding").alias("vec"), (F.get("embedding", F.lit(0)) > 0).cast("int").alias("mask")
    )
    return marks.masked_mean(tokens, ["label"])


@query(
    "a24_mark_stats",
    f"WITH {MARKED}, flat AS (SELECT CAST(unnest(x_mark) AS DOUBLE) AS v FROM mw), "
    f"steps AS (SELECT list_sum(list_transform(range(1, {MARK_DIM} + 1), lambda i: abs(CAST(x_mark[i + {MARK_DIM}] AS DOUBLE) - CAST(x_mark[i] AS DOUBLE)))) / {MARK_DIM} AS s FROM mw) "
    f"SELECT {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS sd, {r6('min(v)')} AS low, {r6('max(v)')} AS high, "
    f"(SELECT {r6('avg(s)')} FROM steps) AS mean_step FROM flat",
)
def _(spark, d):
    return marks.mark_stats(marked_windows(spark, d))


# Step 1 adds the newest lookback mark, step 2 also the first horizon mark; a zeroed half leaves the other's share.
WEIGHT = 10.0
SHARE = "list_sum(list_transform({e}, lambda q: CAST(q AS DOUBLE))) / " + str(2 * MARK_DIM)
ABLATION = (
    f"WITH {EVERY_WINDOW}, {VEC}, sh AS (SELECT {SHARE.format(e='a1.emb')} AS t1, {SHARE.format(e='a2.emb')} AS t2, "
    f"{SHARE.format(e='b1.emb')} AS w1, {SHARE.format(e='b2.emb')} AS w2 FROM tw "
    f"JOIN marks a1 ON a1.t = tw.s_begin + {SEQ - TOKEN} JOIN marks a2 ON a2.t = tw.s_begin + {SEQ} "
    f"JOIN wmarks b1 ON b1.station = tw.station AND b1.t = tw.s_begin + {SEQ - TOKEN} "
    f"JOIN wmarks b2 ON b2.station = tw.station AND b2.t = tw.s_begin + {SEQ}) SELECT "
    + ", ".join(
        f"round({WEIGHT} * avg((abs({one}) + abs({one} + {two})) / 2), 6) AS full_vs_{name}"
        for name, one, two in (("none", "t1 + w1", "t2 + w2"), ("time", "w1", "w2"), ("weather", "t1", "t2"))
    )
    + " FROM sh"
)


@query("a23_mark_ablation", ABLATION)
def _(spark, d):
    return P.ablation(both_marks(spark, d), P.forecaster("marked_persistence", TOKEN, WEIGHT), PRED, TOKEN)


