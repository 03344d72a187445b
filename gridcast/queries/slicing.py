"""Scaling, splits, windows, tokens and ragged series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions import permute
from gridcast.functions import vectors as V
from gridcast.functions.draws import draw_sql
from gridcast.functions.numbers import clamp_min, unstandardise
from gridcast.functions.times import day_of
from gridcast.operators import axis, grid, ragged, scale, split, windows
from gridcast.operators import fill as fills
from gridcast.queries.base import TYPE_H, arr, filled_sql, grid_sql, query, r6
from gridcast.sources import events as E

HOUR = 3600
SEQ, LABEL, TOKEN, PRED = 48, 36, 12, 24
LENGTH = SEQ + PRED

# ---- the filled hourly table ---------------------------------------------------

FILLED = f"{TYPE_H}, {grid_sql('type_h')}, {filled_sql('grid')}, size AS (SELECT max(t) + 1 AS n FROM filled)"
N_TRAIN = "CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)"
N_VAL = "CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)"
N_TEST = "CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)"


def bounds_sql(val_is_rest: bool | None = None, name: str = "bounds") -> str:
    """Split bounds as rows; ``None`` is the disjoint split, else the look-back one."""
    if val_is_rest is None:
        rows = [("train", "0", N_TRAIN), ("val", N_TRAIN, f"{N_TRAIN} + {N_VAL}"), ("test", f"{N_TRAIN} + {N_VAL}", "n")]
    else:
        n_val = f"n - {N_TRAIN} - {N_TEST}" if val_is_rest else N_VAL
        rows = [
            ("train", "0", N_TRAIN),
            ("val", f"{N_TRAIN} - {SEQ}", f"{N_TRAIN} + {n_val}"),
            ("test", f"n - {N_TEST} - {SEQ}", "n"),
        ]
    parts = " UNION ALL ".join(f"SELECT '{s}' AS split, {lo} AS b1, {hi} AS b2 FROM size" for s, lo, hi in rows)
    return f"{name} AS ({parts})"


def starts_sql(length: int = LENGTH, source: str = "filled", bounds: str = "bounds", name: str = "starts", shift: int = 0) -> str:
    return (
        f"{name} AS (SELECT f.station, b.split, f.t AS s_begin FROM {source} f JOIN {bounds} b "
        f"ON f.t >= b.b1 AND f.t <= b.b2 - {length + shift})"
    )


def span_sql(source: str, lo: str, n: int, col: str = "target") -> str:
    """Ordered list of ``n`` values from position ``lo`` of the same station."""
    return f"list({source}.{col} ORDER BY {source}.t) FILTER ({source}.t >= {lo} AND {source}.t < {lo} + {n})"


def windows_sql(seq: int = SEQ, label: int = LABEL, pred: int = PRED, source: str = "filled", name: str = "win") -> str:
    return (
        f"{name} AS (SELECT s.station, s.split, s.s_begin, {span_sql('f', 's.s_begin', seq)} AS x, "
        f"{span_sql('f', f's.s_begin + {seq - label}', label + pred)} AS y FROM starts s JOIN {source} f "
        f"ON f.station = s.station AND f.t >= s.s_begin AND f.t < s.s_begin + {seq + pred} "
        "GROUP BY s.station, s.split, s.s_begin)"
    )


WINDOWS = f"{FILLED}, {bounds_sql()}, {starts_sql()}, {windows_sql()}"


def filled_hours(spark, d):
    """(filled table, number of positions)."""
    r = E.type_readings(spark, d)
    limits = grid.extent_of(r)
    return fills.fill_linear(grid.regular_grid(r, HOUR, limits=limits, carry=True)), limits.steps(HOUR)


def hour_windows(spark, d, only=None, seq=SEQ, label=LABEL, pred=PRED):
    df, n = filled_hours(spark, d)
    ranges = split.ratio_ranges(n)
    return windows.windows(df, seq, label, pred, ranges.only(*only) if only else ranges)


# ---- scaling -------------------------------------------------------------------

TRAIN_PARAMS = (
    f"params AS (SELECT station, avg(target) AS mu, greatest(stddev_pop(target), 1e-6) AS sd FROM filled, size "
    f"WHERE t < {N_TRAIN} GROUP BY station)"
)


@query("a14_train_scale", f"WITH {FILLED}, {TRAIN_PARAMS} SELECT station, {r6('mu')} AS mu, {r6('sd')} AS sd FROM params")
def _(spark, d):
    df, n = filled_hours(spark, d)
    return scale.train_scale(df, split.ratio_ranges(n).end("train"))


@query(
    "a15_full_scale",
    f"WITH {FILLED} SELECT station, {r6('avg(target)')} AS mu, {r6('stddev_pop(target) + 1e-6')} AS sd FROM filled GROUP BY station",
)
def _(spark, d):
    return scale.full_scale(filled_hours(spark, d)[0])


@query(
    "a16_channel_scale",
    f"WITH {FILLED} SELECT station AS channel, {r6('avg(target)')} AS mu, "
    f"{r6('CASE WHEN stddev_pop(target) = 0 THEN 1 ELSE stddev_pop(target) END')} AS sd FROM filled, size "
    f"WHERE t < {N_TRAIN} GROUP BY station",
)
def _(spark, d):
    df, n = filled_hours(spark, d)
    channels = df.select(F.col("station").alias("channel"), "t", F.col("target").alias("value"))
    return scale.channel_scale(channels, split.lookback_ranges(n, SEQ).end("train"))


@query(
    "f08_standardise",
    f"WITH {FILLED}, {TRAIN_PARAMS} SELECT f.station, f.t, {r6('(f.target - p.mu) / p.sd')} AS scaled, {r6('f.target')} AS restored "
    "FROM filled f JOIN params p USING (station)",
)
def _(spark, d):
    df, n = filled_hours(spark, d)
    scaled = scale.apply_scale(df, scale.train_scale(df, split.ratio_ranges(n).end("train")))
    restored = unstandardise(F.col("target"), F.col("mu"), F.col("sd"))
    return scaled.select("station", "t", F.col("target").alias("scaled"), restored.alias("restored"))


@query(
    "f16_clamp",
    "SELECT event_id, greatest(value - 50, 0.000001) AS clamped FROM (SELECT event_id, round(value, 6) AS value FROM events)",
)
def _(spark, d):
    return E.table(spark, d, "events").select("event_id", clamp_min(F.col("value") - 50, 1e-6).alias("clamped"))


# ---- splits --------------------------------------------------------------------


def _split_rows_sql(bounds: str) -> str:
    return (
        f"WITH {FILLED}, {bounds} SELECT f.station, f.t, b.split FROM filled f JOIN bounds b ON f.t >= b.b1 AND f.t < b.b2"
    )


@query("w10_ratio_split", _split_rows_sql(bounds_sql()))
def _(spark, d):
    df, n = filled_hours(spark, d)
    return split.label_split(df, split.ratio_ranges(n)).select("station", "t", "split")


@query("w11_lookback_split", _split_rows_sql(bounds_sql(True)))
def _(spark, d):
    df, n = filled_hours(spark, d)
    return split.explode_splits(df, split.lookback_ranges(n, SEQ)).select("station", "t", "split")


@query("w11_lookback_split_share", _split_rows_sql(bounds_sql(False)))
def _(spark, d):
    df, n = filled_hours(spark, d)
    return split.explode_splits(df, split.lookback_ranges(n, SEQ, val_is_rest=False)).select("station", "t", "split")


# The fixed calendar split with a 24-hour month, so that 720 hours hold 12 + 4 + 4 units.
@query(
    "w12_calendar_split",
    _split_rows_sql(
        f"bounds AS (SELECT 'train' AS split, 0 AS b1, 288 AS b2 UNION ALL SELECT 'val', 288 - {SEQ}, 384 UNION ALL SELECT 'test', 384 - {SEQ}, 480)"
    ),
)
def _(spark, d):
    df, _n = filled_hours(spark, d)
    return split.explode_splits(df, split.calendar_ranges(SEQ, unit=24)).select("station", "t", "split")


# ---- windows -------------------------------------------------------------------


@query("w15_window_index", f"WITH {FILLED}, {bounds_sql()}, {starts_sql()} SELECT station, split, s_begin FROM starts")
def _(spark, d):
    r = E.type_readings(spark, d)
    n = grid.extent_of(r).steps(HOUR)
    series = r.select("station").distinct().withColumn("n", F.lit(n))
    return windows.windows_index(series, LENGTH, split.ratio_ranges(n))


@query(
    "w15_short_split_is_empty",
    f"WITH {FILLED}, {bounds_sql()}, {starts_sql(120)} SELECT split, count(*) AS windows FROM starts GROUP BY split",
)
def _(spark, d):
    r = E.type_readings(spark, d)
    n = grid.extent_of(r).steps(HOUR)
    series = r.select("station").distinct().withColumn("n", F.lit(n))
    index = windows.windows_index(series, 96 + 24, split.ratio_ranges(n))
    return index.groupBy("split").agg(F.count(F.lit(1)).alias("windows"))


@query(
    "w09_contiguous_windows",
    "WITH sparse AS (SELECT to_timestamp(CAST(floor(epoch(ts) / 900) * 900 AS BIGINT))::TIMESTAMP AS datetime, event_type AS station, "
    "value AS target FROM events), ax AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS t FROM (SELECT DISTINCT datetime FROM sparse)), "
    "filled AS (SELECT s.station, ax.t FROM (SELECT DISTINCT station FROM sparse) s CROSS JOIN ax), size AS (SELECT count(*) AS n FROM ax), "
    f"{bounds_sql()}, {starts_sql(24)}, br AS (SELECT t, CASE WHEN t > 0 AND datetime - lag(datetime) OVER (ORDER BY t) <> INTERVAL 15 MINUTE "
    "THEN 1 ELSE 0 END AS b FROM ax), pre AS (SELECT t, sum(b) OVER (ORDER BY t) AS p FROM br) "
    "SELECT s.station, s.split, s.s_begin FROM starts s JOIN pre a ON a.t = s.s_begin JOIN pre z ON z.t = s.s_begin + 23 WHERE a.p = z.p",
)
def _(spark, d):
    r = E.type_readings(spark, d, 900)
    ax = axis.time_axis(r)
    n = grid.axis_length(ax)
    series = r.select("station").distinct().withColumn("n", F.lit(n))
    index = windows.windows_index(series, 24, split.ratio_ranges(n))
    return windows.keep_contiguous(index, axis.contiguous_starts(ax, 24, 900))


@query("w16_windows", f"WITH {WINDOWS} SELECT station, split, s_begin, {arr('x')} AS x, {arr('y')} AS y FROM win")
def _(spark, d):
    return hour_windows(spark, d)


@query(
    "w17_channel_windows",
    f"WITH {FILLED}, {bounds_sql(True)}, {starts_sql()}, {windows_sql()} "
    f"SELECT station AS channel, split, s_begin, {arr('x')} AS x, {arr('y')} AS y FROM win",
)
def _(spark, d):
    df, n = filled_hours(spark, d)
    channels = df.select(F.col("station").alias("channel"), "t", F.col("target").alias("value"))
    return windows.windows(
        channels, SEQ, LABEL, PRED, split.lookback_ranges(n, SEQ), keys=["channel"], value="value"
    )


def _precut_sql(shift: int) -> str:
    return (
        f"WITH {FILLED}, bounds AS (SELECT 'all' AS split, 0 AS b1, n AS b2 FROM size), {starts_sql(shift=shift)}, "
        f"{windows_sql(label=0)} SELECT station, s_begin, {arr('x')} AS x, {arr('y')} AS y FROM win"
    )


@query("w18_precut_pairs", _precut_sql(1))
def _(spark, d):
    df, n = filled_hours(spark, d)
    return windows.precut_pairs(df, SEQ, PRED, n, include_last=False)


@query("w18_precut_pairs_all", _precut_sql(0))
def _(spark, d):
    df, n = filled_hours(spark, d)
    return windows.precut_pairs(df, SEQ, PRED, n)


@query(
    "w19_label_tail",
    f"WITH {FILLED}, bounds AS (SELECT 'all' AS split, 0 AS b1, n AS b2 FROM size), {starts_sql()}, "
    f"{windows_sql(label=LABEL)} SELECT station, s_begin, {arr('x')} AS x, {arr('y')} AS y FROM win",
)
def _(spark, d):
    df, n = filled_hours(spark, d)
    return windows.with_label_tail(windows.precut_pairs(df, SEQ, PRED, n), LABEL)


@query(
    "w14_sample_order_split",
    f"WITH {FILLED}, bounds AS (SELECT 'all' AS split, 0 AS b1, n AS b2 FROM size), {starts_sql()}, "
    "ranked AS (SELECT station, s_begin, row_number() OVER (ORDER BY station, s_begin) - 1 AS sample_id, count(*) OVER () AS n FROM starts) "
    f"SELECT station, s_begin, sample_id, CASE WHEN sample_id < {N_TRAIN} THEN 'train' WHEN sample_id < {N_TRAIN} + {N_VAL} THEN 'val' "
    "ELSE 'test' END AS split FROM ranked",
)
def _(spark, d):
    r = E.type_readings(spark, d)
    n = grid.extent_of(r).steps(HOUR)
    series = r.select("station").distinct().withColumn("n", F.lit(n))
    index = windows.windows_index(series, LENGTH, split.Ranges({"all": (0, n)})).drop("split")
    return split.sample_order_split(index, station="station")


@query(
    "w14_contiguous_sample_split",
    "WITH sparse AS (SELECT to_timestamp(CAST(floor(epoch(ts) / 900) * 900 AS BIGINT))::TIMESTAMP AS datetime, event_type AS station FROM events), "
    "ax AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS t FROM (SELECT DISTINCT datetime FROM sparse)), "
    "br AS (SELECT t, CASE WHEN t > 0 AND datetime - lag(datetime) OVER (ORDER BY t) <> INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS b FROM ax), "
    "pre AS (SELECT t, sum(b) OVER (ORDER BY t) AS p FROM br), ok AS (SELECT a.t FROM pre a JOIN pre z ON z.t = a.t + 7 WHERE a.p = z.p), "
    "ranked AS (SELECT s.station, ok.t AS s_begin, row_number() OVER (ORDER BY s.station, ok.t) - 1 AS sample_id, count(*) OVER () AS n "
    "FROM (SELECT DISTINCT station FROM sparse) s CROSS JOIN ok) "
    f"SELECT station, s_begin, sample_id, CASE WHEN sample_id < {N_TRAIN} THEN 'train' WHEN sample_id < {N_TRAIN} + {N_VAL} THEN 'val' "
    "ELSE 'test' END AS split FROM ranked",
)
def _(spark, d):
    r = E.type_readings(spark, d, 900)
    ax = axis.time_axis(r)
    n = grid.axis_length(ax)
    series = r.select("station").distinct().withColumn("n", F.lit(n))
    index = windows.windows_index(series, 8, split.Ranges({"all": (0, n)})).drop("split")
    return split.sample_order_split(windows.keep_contiguous(index, axis.contiguous_starts(ax, 8, 900)), station="station")


def permuted_sql(perm: permute.Permutation, source: str) -> str:
    """``source`` (with ``i`` and ``n``) with ``i`` permuted once, as nested selects; ``a`` and ``b`` are the digits' sizes."""
    out = f"SELECT *, i // b AS l, i % b AS r FROM {source}"
    for key_a, key_b in perm.keys():
        out = f"SELECT * REPLACE ((l + ((r + {key_a}) % {permute.PRIME}) * ((r + {key_a}) % {permute.PRIME}) % {permute.PRIME}) % a AS l) FROM ({out})"
        out = f"SELECT * REPLACE ((r + ((l + {key_b}) % {permute.PRIME}) * ((l + {key_b}) % {permute.PRIME}) % {permute.PRIME}) % b AS r) FROM ({out})"
    return f"SELECT * EXCLUDE (l, r) REPLACE (l * b + r AS i) FROM ({out})"


SHUFFLE_SEED, BATCH = 2021, 32
_PERM = permute.Permutation(1, SHUFFLE_SEED)


@query(
    "o06_shuffled_batches",
    f"WITH RECURSIVE {FILLED}, {bounds_sql()}, {starts_sql()}, "
    "numbered AS (SELECT station, split, s_begin, CAST(row_number() OVER (ORDER BY station, s_begin) - 1 AS BIGINT) AS i, CAST(count(*) OVER () AS BIGINT) AS n "
    "FROM starts WHERE split = 'train'), sized AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM numbered), "
    "digits AS (SELECT *, (n + a - 1) // a AS b FROM sized), "
    f"walk AS ({permuted_sql(_PERM, 'digits')} UNION ALL {permuted_sql(_PERM, '(SELECT * FROM walk WHERE i >= n)')}) "
    f"SELECT station, split, s_begin, i AS position, i // {BATCH} AS batch FROM walk WHERE i < n AND i // {BATCH} < n // {BATCH}",
)
def _(spark, d):
    r = E.type_readings(spark, d)
    n = grid.extent_of(r).steps(HOUR)
    series = r.select("station").distinct().withColumn("n", F.lit(n))
    index = windows.windows_index(series, LENGTH, split.ratio_ranges(n).only("train"))
    return windows.shuffled_batches(index, SHUFFLE_SEED, BATCH, ["station", "s_begin"])


# ---- tokens and per-window functions -------------------------------------------

TEST_WINDOWS = f"{FILLED}, {bounds_sql()}, {starts_sql()}, {windows_sql()}, tw AS (SELECT * FROM win WHERE split = 'test')"
EVERY_WINDOW = f"{FILLED}, {bounds_sql()}, {starts_sql()}, {windows_sql()}, tw AS (SELECT * FROM win)"


def test_windows(spark, d):
    return hour_windows(spark, d, only=["test"])


def every_window(spark, d):
    return hour_windows(spark, d)


@query(
    "f11_tokenise",
    f"WITH {EVERY_WINDOW}, p AS (SELECT station, s_begin, x, unnest(range({SEQ // TOKEN})) AS pos FROM tw) "
    f"SELECT station, s_begin, CAST(pos AS INTEGER) AS pos, {arr(f'x[pos * {TOKEN} + 1 : pos * {TOKEN} + {TOKEN}]')} AS token FROM p",
)
def _(spark, d):
    t = every_window(spark, d)
    return t.select("station", "s_begin", F.posexplode(V.tokens(F.col("x"), TOKEN)).alias("pos", "token"))


@query("f12_detokenise", f"WITH {EVERY_WINDOW} SELECT station, s_begin, {arr('x')} AS x FROM tw")
def _(spark, d):
    t = every_window(spark, d)
    return t.select("station", "s_begin", V.untokenise(V.tokens(F.col("x"), TOKEN)).alias("x"))


@query(
    "f15_slices",
    f"WITH {EVERY_WINDOW} SELECT station, s_begin, {arr(f'list_concat(x[1:5], x[-{TOKEN}:])')} AS ends FROM tw",
)
def _(spark, d):
    x = F.col("x")
    return every_window(spark, d).select("station", "s_begin", F.concat(V.head(x, 5), V.tail(x, TOKEN)).alias("ends"))


NORMED = (
    f"{EVERY_WINDOW}, m AS (SELECT *, list_sum(x) / len(x) AS mean FROM tw), "
    "v AS (SELECT *, sqrt(list_sum(list_transform(x, lambda q: (q - mean) * (q - mean))) / len(x) + 1e-5) AS sd FROM m)"
)


@query(
    "f09_instance_norm",
    f"WITH {NORMED} SELECT station, s_begin, {r6('mean')} AS mean, {r6('sd')} AS sd, "
    f"{arr('list_transform(x, lambda q: (q - mean) / sd)')} AS x FROM v",
)
def _(spark, d):
    stats = V.instance_norm("x")
    t = every_window(spark, d).withColumn("mean", stats["mean"]).withColumn("sd", stats["sd"])
    return t.select("station", "s_begin", "mean", "sd", V.normalise(F.col("x"), F.col("mean"), F.col("sd")).alias("x"))


@query(
    "f10_instance_denorm",
    f"WITH {NORMED} SELECT station, s_begin, {arr('list_transform(x, lambda q: round(q, 9))')} AS x FROM v",
)
def _(spark, d):
    stats = V.instance_norm("x")
    t = every_window(spark, d).withColumn("mean", stats["mean"]).withColumn("sd", stats["sd"])
    normed = V.normalise(F.col("x"), F.col("mean"), F.col("sd"))
    back = V.denormalise(normed, F.col("mean"), F.col("sd"))
    # The noise of going there and back must not decide how a half is rounded in the digest.
    return t.select("station", "s_begin", F.transform(back, lambda v: F.round(v, 9)).alias("x"))


# ---- ragged series -------------------------------------------------------------

PTS = (
    "raw AS (SELECT o_custkey AS series, o_orderdate AS placed, o_orderkey AS seq, "
    "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS y FROM orders), "
    "pts AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY placed, seq) - 1 AS t, y FROM raw WHERE y IS NOT NULL), "
    "lens AS (SELECT series, count(*) AS n FROM pts GROUP BY series), "
    "sized AS (SELECT p.*, l.n FROM pts p JOIN lens l USING (series))"
)
S_SEQ, S_LABEL, S_PRED = 6, 3, 3
S_TOKEN = 2
MIN_LEN = S_SEQ + S_PRED


def order_points(spark, d):
    return ragged.with_positions(
        E.order_series(spark, d), ["at", "seq"], {"_day": day_of("at"), "_cut": F.floor(F.col("seq") / 1_000_000)}
    )


@query("p20_strip_missing", f"WITH {PTS} SELECT series, t, {r6('y')} AS y FROM pts")
def _(spark, d):
    return order_points(spark, d).drop("n")


@query("p19_drop_short", f"WITH {PTS} SELECT series, t, {r6('y')} AS y FROM sized WHERE n > {4 * S_TOKEN}")
def _(spark, d):
    return ragged.drop_short(order_points(spark, d), S_TOKEN).drop("n")


PADDED = (
    f"padded AS (SELECT series, t + greatest({MIN_LEN} - n, 0) AS t, y FROM sized UNION ALL "
    f"SELECT series, unnest(range({MIN_LEN} - n)) AS t, 0.0 AS y FROM lens WHERE n < {MIN_LEN})"
)


@query("w22_left_padding", f"WITH {PTS}, {PADDED} SELECT series, CAST(t AS BIGINT) AS t, {r6('y')} AS y FROM padded")
def _(spark, d):
    return ragged.pad_front(order_points(spark, d), MIN_LEN).drop("n")


@query(
    "w13_per_series_windows",
    f"WITH {PTS}, {PADDED}, plens AS (SELECT series, count(*) AS n FROM padded GROUP BY series), "
    f"b AS (SELECT series, 'train' AS split, 0 AS b1, n - {2 * S_PRED} AS b2 FROM plens UNION ALL "
    f"SELECT series, 'val', greatest(n - {2 * S_PRED + S_SEQ}, 0), n - {S_PRED} FROM plens UNION ALL "
    f"SELECT series, 'test', greatest(n - {S_PRED + S_SEQ}, 0), n FROM plens), "
    f"st AS (SELECT p.series, b.split, p.t AS s FROM padded p JOIN b ON b.series = p.series AND p.t >= b.b1 AND p.t <= b.b2 - {MIN_LEN}) "
    f"SELECT st.series, st.split, CAST(st.s AS BIGINT) AS s_begin, {arr(span_sql('p', 'st.s', S_SEQ, 'y'))} AS x, "
    f"{arr(span_sql('p', f'st.s + {S_SEQ - S_LABEL}', S_LABEL + S_PRED, 'y'))} AS y FROM st JOIN padded p "
    f"ON p.series = st.series AND p.t >= st.s AND p.t < st.s + {MIN_LEN} GROUP BY st.series, st.split, st.s",
)
def _(spark, d):
    return ragged.series_windows(order_points(spark, d), S_SEQ, S_LABEL, S_PRED)


LAST = (
    f"lw AS (SELECT series, list(y ORDER BY t) AS w FROM sized WHERE t >= n - {S_SEQ} GROUP BY series), "
    f"last_w AS (SELECT series, list_concat(list_transform(range({S_SEQ} - len(w)), lambda i: 0.0), w) AS x, "
    f"list_concat(list_transform(range({S_SEQ} - len(w)), lambda i: 0.0), list_transform(w, lambda i: 1.0)) AS mask FROM lw)"
)


@query("w24_last_window", f"WITH {PTS}, {LAST} SELECT series, {arr('x')} AS x, {arr('mask')} AS mask FROM last_w")
def _(spark, d):
    return ragged.last_window(order_points(spark, d), S_SEQ)


PROMPT = (
    f"ends AS (SELECT series, list(y ORDER BY t) AS w FROM sized WHERE n > {4 * S_TOKEN} AND (t < {2 * S_TOKEN} OR t >= n - {2 * S_TOKEN}) "
    f"GROUP BY series), prompt AS (SELECT series, w[1:{3 * S_TOKEN}] AS x, w[{3 * S_TOKEN + 1}:{4 * S_TOKEN}] AS y FROM ends)"
)


@query("w25_prompt_window", f"WITH {PTS}, {PROMPT} SELECT series, {arr('x')} AS x, {arr('y')} AS y FROM prompt")
def _(spark, d):
    return ragged.prompt_window(order_points(spark, d), S_TOKEN)


CUT_LIMIT = 6


@query(
    "w23_random_cut_windows",
    f"WITH {PTS}, lows AS (SELECT series, n, greatest(1, n - {CUT_LIMIT}) AS low FROM lens), "
    f"cuts AS (SELECT series, n, low + {draw_sql(SHUFFLE_SEED, 'series')} % greatest(n - low, 1) AS cut FROM lows), "
    f"got AS (SELECT c.series, c.n, c.cut, coalesce(list(p.y ORDER BY p.t) FILTER (p.t >= c.cut - {S_SEQ} AND p.t < c.cut), []) AS i, "
    f"coalesce(list(p.y ORDER BY p.t) FILTER (p.t >= greatest(c.cut - {S_LABEL}, 0) AND p.t < c.cut + {S_PRED}), []) AS o "
    "FROM cuts c JOIN pts p USING (series) GROUP BY c.series, c.n, c.cut), "
    f"gaps AS (SELECT *, list_transform(range({S_SEQ} - len(i)), lambda v: 0.0) AS zi, "
    f"list_transform(range({S_LABEL + S_PRED} - len(o)), lambda v: 0.0) AS zo FROM got) "
    f"SELECT series, n, cut, {arr('list_concat(zi, i)')} AS insample, {arr('list_concat(zi, list_transform(i, lambda v: 1.0))')} AS insample_mask, "
    f"{arr('list_concat(o, zo)')} AS outsample, {arr('list_concat(list_transform(o, lambda v: 1.0), zo)')} AS outsample_mask FROM gaps",
)
def _(spark, d):
    return ragged.random_cut_windows(order_points(spark, d), S_SEQ, S_LABEL, S_PRED, limit=CUT_LIMIT, seed=SHUFFLE_SEED)


@query(
    "w21_zero_marks",
    f"WITH {EVERY_WINDOW} SELECT station, s_begin, {arr(f'list_transform(range({SEQ // TOKEN} * 8), lambda i: 0.0)')} AS x_mark, "
    f"{arr(f'list_transform(range({(LABEL + PRED) // TOKEN} * 8), lambda i: 0.0)')} AS y_mark FROM tw",
)
def _(spark, d):
    return every_window(spark, d).select(
        "station",
        "s_begin",
        V.zero_marks(SEQ // TOKEN, 8).alias("x_mark"),
        V.zero_marks((LABEL + PRED) // TOKEN, 8).alias("y_mark"),
    )
