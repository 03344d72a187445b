"""Forecasters, rollouts, evaluation tasks, metrics, anomaly flags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridcast.functions import vectors as V
from gridcast.functions.numbers import divide_or_zero
from gridcast.functions.times import floor_time
from gridcast.operators import anomaly, grid, ragged, split, windows
from gridcast.operators import fill as fills
from gridcast.plans import forecasting as P
from gridcast.plans import metrics as M
from gridcast.plans import naive2
from gridcast.queries.base import SHIP, arr, filled_sql, query, r6
from gridcast.queries.slicing import (
    FILLED,
    LABEL,
    LAST,
    N_TEST,
    N_TRAIN,
    N_VAL,
    PRED,
    PROMPT,
    PTS,
    S_SEQ,
    S_TOKEN,
    SEQ,
    TEST_WINDOWS,
    TOKEN,
    bounds_sql,
    hour_windows,
    order_points,
    starts_sql,
    test_windows,
    windows_sql,
)
from gridcast.sources import events as E

KEYS = ["station", "s_begin"]
FREQ = 24
ODD_PRED, ODD_TOKEN = 20, 12

# ---- forecast rows -------------------------------------------------------------

# Daily-season forecast of every test window beside the truth.
ROWS = (
    f"{TEST_WINDOWS}, steps AS (SELECT CAST(range AS INTEGER) AS step FROM range({PRED})), "
    f"fr AS (SELECT w.station, w.s_begin, k.step, w.x[{SEQ - FREQ} + 1 + k.step % {FREQ}] AS pred, w.y[{LABEL} + 1 + k.step] AS truth FROM tw w CROSS JOIN steps k)"
)


def day_ahead(spark, d, token=PRED):
    model = P.forecaster("seasonal", token, FREQ)
    return P.rollout(test_windows(spark, d), model, PRED, token)


def day_ahead_rows(spark, d):
    return P.forecast_rows(day_ahead(spark, d), PRED, KEYS)


def metric_sql(**parts: str) -> str:
    return f"WITH {ROWS} SELECT " + ", ".join(f"{r6(e)} AS {n}" for n, e in parts.items()) + " FROM fr"


@query(
    "j10_forecast_alignment",
    f"WITH {ROWS} SELECT station, s_begin, step, {r6('pred')} AS pred, {r6('truth')} AS \"true\" FROM fr",
)
def _(spark, d):
    forecast = P.forecast_rows(day_ahead(spark, d), PRED, KEYS).drop("true")
    truth = test_windows(spark, d).select(
        *KEYS, F.posexplode(V.tail(F.col("y"), PRED)).alias("step", "true")
    )
    return P.align(forecast, truth, KEYS)


@query("m01_mae", metric_sql(mae="avg(abs(pred - truth))"))
def _(spark, d):
    return M.aggregate(day_ahead_rows(spark, d), mae=M.mae())


@query("m02_mse", metric_sql(mse="avg((pred - truth) * (pred - truth))"))
def _(spark, d):
    return M.aggregate(day_ahead_rows(spark, d), mse=M.mse())


@query("m03_rmse", metric_sql(rmse="sqrt(avg((pred - truth) * (pred - truth)))"))
def _(spark, d):
    return M.aggregate(day_ahead_rows(spark, d), rmse=M.rmse())


@query("m04_mape", metric_sql(mape="avg(abs((pred - truth) / nullif(truth, 0)))"))
def _(spark, d):
    return M.aggregate(day_ahead_rows(spark, d), mape=M.mape())


@query("m05_mspe", metric_sql(mspe="avg(power((pred - truth) / nullif(truth, 0), 2))"))
def _(spark, d):
    return M.aggregate(day_ahead_rows(spark, d), mspe=M.mspe())


@query("m06_rse", metric_sql(rse="sqrt(sum(power(truth - pred, 2))) / sqrt(sum(power(truth - (SELECT avg(truth) FROM fr), 2)))"))
def _(spark, d):
    return M.aggregate(day_ahead_rows(spark, d), rse=M.rse())


@query(
    "m07_step_correlation",
    f"WITH {ROWS}, cm AS (SELECT *, truth - avg(truth) OVER (PARTITION BY step) AS a, pred - avg(pred) OVER (PARTITION BY step) AS b FROM fr), "
    "c AS (SELECT step, sum(a * b) / sqrt(sum(a * a * b * b)) AS v FROM cm GROUP BY step) "
    f"SELECT {r6('avg(v)')} AS corr FROM c",
)
def _(spark, d):
    return M.step_correlation(day_ahead_rows(spark, d))


BUNDLE = (
    f"count(*) AS rows, count(*) FILTER (truth = 0) AS zero_truths, {r6('avg(abs(pred - truth))')} AS mae, "
    f"{r6('avg((pred - truth) * (pred - truth))')} AS mse, {r6('sqrt(avg((pred - truth) * (pred - truth)))')} AS rmse, "
    f"{r6('avg(abs((pred - truth) / nullif(truth, 0)))')} AS mape, {r6('avg(power((pred - truth) / nullif(truth, 0), 2))')} AS mspe"
)


@query("m08_metric_bundle", f"WITH {ROWS} SELECT {BUNDLE} FROM fr")
def _(spark, d):
    return M.bundle(day_ahead_rows(spark, d))


@query("m09_smape", metric_sql(smape="avg(200 * abs(pred - truth) / (abs(pred) + abs(truth) + 1e-8))"))
def _(spark, d):
    return M.aggregate(day_ahead_rows(spark, d), smape=M.smape())


@query("m10_mape_percent", metric_sql(mape="avg(abs(100 * (pred - truth) / (truth + 1e-8)))"))
def _(spark, d):
    return M.aggregate(day_ahead_rows(spark, d), mape=M.mape_percent())


# ---- masked metrics on last windows --------------------------------------------

# Last known value of a series against its newest token; padded cells are masked out.
S_ROWS = (
    f"{PTS}, lw AS (SELECT series, list(y ORDER BY t) AS w, max(n) AS n FROM sized WHERE t >= n - {S_SEQ + S_TOKEN} GROUP BY series), "
    f"pad AS (SELECT series, n, list_concat(list_transform(range({S_SEQ + S_TOKEN} - len(w)), lambda i: 0.0), w) AS w, "
    f"list_concat(list_transform(range({S_SEQ + S_TOKEN} - len(w)), lambda i: 0.0), list_transform(w, lambda i: 1.0)) AS m FROM lw), "
    f"cellrows AS (SELECT series, n, w, m, unnest(range(1, {S_TOKEN} + 1)) AS i FROM pad), "
    f"fr AS (SELECT series, CASE WHEN n < 6 THEN 'short' WHEN n < 9 THEN 'middle' ELSE 'long' END AS pattern, w[{S_SEQ}] AS pred, "
    f"w[{S_SEQ} + i] AS truth, m[{S_SEQ} + i] AS mask, "
    f"list_sum(list_transform(range(2, {S_SEQ} + 1), lambda j: abs(w[j] - w[j - 1]))) / {S_SEQ - 1} AS scale FROM cellrows)"
)
DIV_MT = "CASE WHEN truth = 0 THEN 0 ELSE mask / truth END"
DIV_MS = "CASE WHEN scale = 0 THEN 0 ELSE mask / scale END"
DIV_E = "CASE WHEN abs(pred) + abs(truth) = 0 THEN 0 ELSE abs(pred - truth) / (abs(pred) + abs(truth)) END"
MASKED = {
    "mape": f"avg(abs((pred - truth) * ({DIV_MT})))",
    "smape": f"200 * avg(({DIV_E}) * mask)",
    "mase": f"avg(abs(pred - truth) * ({DIV_MS}))",
}


def masked_rows(spark, d):
    """``(series, pattern, pred, true, mask, scale)`` for the newest token of every series."""
    points = order_points(spark, d)
    whole = ragged.last_window(points, S_SEQ + S_TOKEN)
    sized = whole.join(ragged.lengths(points), ragged.KEY)
    pattern = F.when(F.col("n") < 6, "short").when(F.col("n") < 9, "middle").otherwise("long")
    past = V.head(F.col("x"), S_SEQ)
    model = P.forecaster("last_value", S_TOKEN)
    cut = sized.select(
        ragged.KEY,
        pattern.alias("pattern"),
        V.tail(F.col("x"), S_TOKEN).alias("truth"),
        V.tail(F.col("mask"), S_TOKEN).alias("mask"),
        past.alias("x"),
    )
    out = P.rollout(cut, model, S_TOKEN, S_TOKEN).withColumn("scale", M.seasonal_scale(F.col("x"), 1))
    cells = F.arrays_zip(F.col("forecast").alias("p"), F.col("truth").alias("t"), F.col("mask").alias("m"))
    return out.select(ragged.KEY, "pattern", "scale", F.explode(cells).alias("_c")).select(
        ragged.KEY,
        "pattern",
        F.col("_c.p").alias("pred"),
        F.col("_c.t").alias("true"),
        F.col("_c.m").alias("mask"),
        "scale",
    )


@query("m11_masked_mape", f"WITH {S_ROWS} SELECT {r6(MASKED['mape'])} AS mape FROM fr")
def _(spark, d):
    return M.aggregate(masked_rows(spark, d), mape=M.masked_mape())


@query("m12_masked_smape", f"WITH {S_ROWS} SELECT {r6(MASKED['smape'])} AS smape FROM fr")
def _(spark, d):
    return M.aggregate(masked_rows(spark, d), smape=M.masked_smape())


@query("m13_masked_mase", f"WITH {S_ROWS} SELECT {r6(MASKED['mase'])} AS mase FROM fr")
def _(spark, d):
    return M.aggregate(masked_rows(spark, d), mase=M.masked_mase())


PER_PATTERN = (
    f"pp AS (SELECT pattern, count(DISTINCT series) AS series_count, {MASKED['smape']} AS smape, 100 * {MASKED['mape']} AS mape, "
    f"{MASKED['mase']} AS mase FROM fr GROUP BY pattern)"
)


@query(
    "m15_pattern_summary",
    f"WITH {S_ROWS}, {PER_PATTERN} SELECT pattern, series_count, {r6('smape')} AS smape, {r6('mape')} AS mape, {r6('mase')} AS mase FROM pp "
    "UNION ALL SELECT 'Average', CAST(sum(series_count) AS BIGINT), "
    + ", ".join(r6(f"sum({m} * series_count) / sum(series_count)") for m in ("smape", "mape", "mase"))
    + " FROM pp",
)
def _(spark, d):
    return M.pattern_summary(masked_rows(spark, d))


# The last two points of each series with more than a season before them, against two forecasts of the rest.
SEASON, AHEAD = 4, 2
OWA_ROWS = (
    f"{PTS}, ins AS (SELECT series, n - {AHEAD} AS n, list(y ORDER BY t)[1 : n - {AHEAD}] AS w, list(y ORDER BY t)[n - {AHEAD - 1} :] AS f FROM sized "
    f"WHERE n > {AHEAD + SEASON} GROUP BY series, n), "
    "mu AS (SELECT *, list_sum(w) / n AS mu FROM ins), "
    + "lagged AS (SELECT *, "
    + ", ".join(f"list_sum(list_transform(range(1, n - {k} + 1), lambda i: (w[i] - mu) * (w[i + {k}] - mu))) AS c{k}" for k in range(SEASON + 1))
    + f", list_sum(list_transform(range(1, n - {SEASON} + 1), lambda i: abs(w[i + {SEASON}] - w[i]))) / (n - {SEASON}) AS scale FROM mu), "
    + f"tested AS (SELECT *, coalesce(list_min(w) > 0 AND n >= {3 * SEASON} AND abs(c{SEASON} / c0) > 1.645 * sqrt((1 + 2 * ("
    + " + ".join(f"power(c{k} / c0, 2)" for k in range(1, SEASON))
    + ")) / n), false) AS seasonal FROM lagged), "
    "ratios AS (SELECT series, (i + 1) % 4 AS place, w[i + 2] / ((0.5 * w[i] + w[i + 1] + w[i + 2] + w[i + 3] + 0.5 * w[i + 4]) / 4) AS ratio "
    "FROM (SELECT series, w, unnest(range(1, n - 3)) AS i FROM tested WHERE seasonal)), "
    "places AS (SELECT series, place, avg(ratio) AS ratio FROM ratios GROUP BY series, place), "
    "idx AS (SELECT series, place, ratio / avg(ratio) OVER (PARTITION BY series) AS v FROM places), "
    f"cells AS (SELECT t.*, unnest(range({AHEAD})) AS step FROM tested t), "
    "owa_rows AS (SELECT c.series, CASE WHEN c.n < 7 THEN 'short' WHEN c.n < 12 THEN 'middle' ELSE 'long' END AS pattern, c.f[c.step + 1] AS truth, "
    "c.w[c.n] AS plain, CASE WHEN seasonal THEN c.w[c.n] / a.v * b.v ELSE c.w[c.n] END AS naive, 1.0 AS mask, c.scale "
    f"FROM cells c LEFT JOIN idx a ON a.series = c.series AND a.place = (c.n - 1) % {SEASON} LEFT JOIN idx b ON b.series = c.series AND b.place = (c.n + c.step) % {SEASON})"
)


def _owa_part(pred: str, name: str) -> str:
    fields = {m: e.replace("pred", pred) for m, e in MASKED.items()}
    return (
        f"{name} AS (SELECT pattern, count(DISTINCT series) AS series_count, {fields['smape']} AS smape, 100 * {fields['mape']} AS mape, "
        f"{fields['mase']} AS mase FROM owa_rows GROUP BY pattern)"
    )


OWA_ALL = (
    f"{OWA_ROWS}, {_owa_part('plain', 'mine')}, {_owa_part('naive', 'bench')}, "
    "both_p AS (SELECT m.*, (m.smape / b.smape + m.mase / b.mase) / 2 AS owa FROM mine m JOIN bench b USING (pattern))"
)


def owa_tables(spark, d):
    """Rows of the forecast by the last value, and of the benchmark, beside the last points of each series."""
    points = order_points(spark, d).where(F.col("n") > AHEAD + SEASON)
    past = naive2.insample(points, AHEAD)
    truth = points.where(F.col("t") >= F.col("n") - AHEAD).select(
        ragged.KEY, (F.col("t") - F.col("n") + AHEAD).cast("int").alias("step"), F.col("y").alias("true"), (F.col("n") - AHEAD).alias("n")
    )
    pattern = F.when(F.col("n") < 7, "short").when(F.col("n") < 12, "middle").otherwise("long")
    rows = truth.join(naive2.seasonal_scales(past, SEASON), ragged.KEY).withColumns({"pattern": pattern, "mask": F.lit(1.0)})
    last = past.where(F.col("t") == F.col("n") - 1).select(ragged.KEY, F.col("y").alias("pred"))
    return rows.join(last, ragged.KEY), rows.join(naive2.naive2(past, SEASON, AHEAD), [ragged.KEY, "step"])


@query(
    "m15_weighted_average",
    f"WITH {OWA_ALL} SELECT pattern, series_count, {r6('smape')} AS smape, {r6('mape')} AS mape, {r6('mase')} AS mase, {r6('owa')} AS owa FROM both_p "
    "UNION ALL SELECT 'Average', CAST(sum(series_count) AS BIGINT), "
    + ", ".join(r6(f"sum({m} * series_count) / sum(series_count)") for m in ("smape", "mape", "mase", "owa"))
    + " FROM both_p",
)
def _(spark, d):
    plain, bench = owa_tables(spark, d)
    naive = M.aggregate(bench, ["pattern"], smape=M.masked_smape(), mase=M.masked_mase())
    return M.pattern_summary(plain, naive)


@query(
    "t08_seasonal_benchmark",
    f"WITH {OWA_ROWS} SELECT c.series, CAST(c.step AS INTEGER) AS step, "
    f"round(CASE WHEN seasonal THEN c.w[c.n] / a.v * b.v ELSE c.w[c.n] END, 6) AS pred "
    f"FROM cells c LEFT JOIN idx a ON a.series = c.series AND a.place = (c.n - 1) % {SEASON} LEFT JOIN idx b ON b.series = c.series AND b.place = (c.n + c.step) % {SEASON}",
)
def _(spark, d):
    points = order_points(spark, d).where(F.col("n") > AHEAD + SEASON)
    return naive2.naive2(naive2.insample(points, AHEAD), SEASON, AHEAD)


@query(
    "m14_accuracy",
    f"SELECT {r6('avg(CAST(((value > 100) = (user_id < 50)) AS INTEGER))')} AS accuracy FROM events",
)
def _(spark, d):
    labels = E.table(spark, d, "events").select(
        (F.col("value") > 100).cast("int").alias("truth"), (F.col("user_id") < 50).cast("int").alias("found")
    )
    return anomaly.accuracy(labels, "truth", "found")


@query(
    "f07_divide_or_zero",
    "SELECT event_id, round(CASE WHEN round(value) % 3 = 0 THEN 0 ELSE value / (round(value) % 3) END, 6) AS ratio FROM events",
)
def _(spark, d):
    den = F.floor(F.col("value") + 0.5) % 3
    return E.table(spark, d, "events").select(
        "event_id", divide_or_zero(F.col("value"), den.cast("double")).alias("ratio")
    )


@query(
    "a21_batch_weighted_loss",
    f"WITH {ROWS}, b AS (SELECT s_begin // 32 AS batch, avg((pred - truth) * (pred - truth)) AS loss, count(*) AS n FROM fr GROUP BY 1) "
    f"SELECT {r6('sum(loss * n) / sum(n)')} AS weighted_loss, {r6('avg(loss)')} AS unweighted_loss, count(*) AS batches FROM b",
)
def _(spark, d):
    rows = day_ahead_rows(spark, d).withColumn("batch", F.floor(F.col("s_begin") / 32))
    return M.batch_weighted(rows)


# ---- forecasters and rollouts --------------------------------------------------


def _roll_sql(expr: str) -> str:
    return f"WITH {TEST_WINDOWS} SELECT station, s_begin, {arr(expr)} AS forecast FROM tw"


@query("t08_last_value", _roll_sql(f"list_transform(range({PRED}), lambda i: x[{SEQ}])"))
def _(spark, d):
    model = P.forecaster("last_value", TOKEN)
    return P.rollout(test_windows(spark, d), model, PRED, TOKEN).select(*KEYS, "forecast")


@query("t08_last_token", _roll_sql(f"list_transform(range({PRED}), lambda i: x[{SEQ - TOKEN} + 1 + i % {TOKEN}])"))
def _(spark, d):
    model = P.forecaster("last_token", TOKEN)
    return P.rollout(test_windows(spark, d), model, PRED, TOKEN).select(*KEYS, "forecast")


@query("t01_seasonal_rollout", _roll_sql(f"list_transform(range({PRED}), lambda i: x[{SEQ - FREQ} + 1 + i % {FREQ}])"))
def _(spark, d):
    return day_ahead(spark, d, token=FREQ).select(*KEYS, "forecast")


@query("t02_trimmed_rollout", _roll_sql(f"list_transform(range({ODD_PRED}), lambda i: x[{SEQ - ODD_TOKEN} + 1 + i % {ODD_TOKEN}])"))
def _(spark, d):
    model = P.forecaster("last_token", ODD_TOKEN)
    return P.rollout(test_windows(spark, d), model, ODD_PRED, ODD_TOKEN).select(*KEYS, "forecast")


HORIZONS = (6, 12, 18, 24)


@query(
    "t03_many_horizons",
    f"WITH {ROWS} SELECT CAST(h.h AS INTEGER) AS horizon, count(*) AS rows, {r6('avg(abs(pred - truth))')} AS mae, "
    f"{r6('avg((pred - truth) * (pred - truth))')} AS mse FROM fr JOIN (SELECT unnest([{', '.join(map(str, HORIZONS))}]) AS h) h ON fr.step < h.h GROUP BY h.h",
)
def _(spark, d):
    model = P.forecaster("seasonal", FREQ, FREQ)
    return P.evaluate_horizons(test_windows(spark, d), model, HORIZONS, FREQ, KEYS)


@query("t10_long_term_task", f"WITH {ROWS} SELECT {BUNDLE} FROM fr")
def _(spark, d):
    run = P.task("long_term_forecast")
    return run(test_windows(spark, d), P.forecaster("seasonal", FREQ, FREQ), PRED, FREQ, KEYS)


@query(
    "t06_last_window_forecast",
    f"WITH {PTS}, {LAST} SELECT series, {arr(f'list_transform(range({S_TOKEN}), lambda i: x[{S_SEQ - S_TOKEN} + 1 + i])')} AS forecast FROM last_w",
)
def _(spark, d):
    last = ragged.last_window(order_points(spark, d), S_SEQ)
    return P.task("short_term_forecast")(last, P.forecaster("last_token", S_TOKEN), S_TOKEN, [ragged.KEY])


# Plain windows end where the horizon starts; prompted windows put the first two tokens in front.
ICL = (
    f"{PTS}, {PROMPT}, zs AS (SELECT series, list(y ORDER BY t) FILTER (t < n - {S_TOKEN}) AS x, list(y ORDER BY t) FILTER (t >= n - {S_TOKEN}) AS y "
    f"FROM sized WHERE n > {4 * S_TOKEN} AND t >= n - {4 * S_TOKEN} GROUP BY series), "
    "both_w AS (SELECT 'zero_shot' AS mode, x, y FROM zs UNION ALL SELECT 'in_context', x, y FROM prompt), "
    f"stepped AS (SELECT mode, list_sum(x) / len(x) AS pred, y, unnest(range(1, {S_TOKEN} + 1)) AS i FROM both_w), "
    "fr AS (SELECT mode, pred, y[i] AS truth FROM stepped)"
)


def mean_forecaster(token_len):
    """A user's own forecaster: the lookback mean, repeated."""
    return lambda df: df.withColumn("token", F.array_repeat(V.array_mean(F.col("x")), token_len))


P.register("lookback_mean", mean_forecaster)


@query(
    "t05_in_context_task",
    f"WITH {ICL} SELECT mode, count(*) AS rows, {r6('avg(200 * abs(pred - truth) / (abs(pred) + abs(truth) + 1e-8))')} AS smape, "
    f"{r6('avg(abs(100 * (pred - truth) / (truth + 1e-8)))')} AS mape FROM fr GROUP BY mode",
)
def _(spark, d):
    points = ragged.drop_short(order_points(spark, d), S_TOKEN)
    plain = ragged.last_window(points, 4 * S_TOKEN).select(
        ragged.KEY,
        V.head(F.col("x"), 3 * S_TOKEN).alias("x"),
        V.tail(F.col("x"), S_TOKEN).alias("y"),
    )
    prompted = ragged.prompt_window(points, S_TOKEN)
    return P.task("in_context_forecast")(plain, prompted, P.forecaster("lookback_mean", S_TOKEN), S_TOKEN, [ragged.KEY])


@query(
    "t09_user_forecaster",
    _roll_sql(
        f"list_transform(range({TOKEN}), lambda i: list_sum(x) / len(x))"
    ),
)
def _(spark, d):
    model = P.forecaster("lookback_mean", TOKEN)
    return P.rollout(test_windows(spark, d), model, TOKEN, TOKEN).select(*KEYS, "forecast")


# ---- rollouts that feed back -----------------------------------------------------

# Quarter-hours; four tokens of a day one after the other, from windows of a week.
L_SEQ, L_LABEL, L_TOKEN, L_STEPS = 672, 576, 96, 4
L_PRED = L_TOKEN * L_STEPS
DAMP, LEVEL = 0.9, 5.0
QUARTERS = (
    "q_h AS (SELECT to_timestamp(CAST(floor(epoch(ts) / 900) * 900 AS BIGINT))::TIMESTAMP AS datetime, event_type AS station, value AS target FROM events), "
    "q_ext AS (SELECT min(datetime) AS lo, max(datetime) AS hi FROM q_h), "
    "q_mean AS (SELECT station, datetime, avg(target) AS target FROM q_h GROUP BY station, datetime), "
    "q_grid AS (SELECT s.station, CAST(date_diff('minute', e.lo, a.datetime) // 15 AS BIGINT) AS t, a.datetime, m.target FROM (SELECT DISTINCT station FROM q_h) s "
    "CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS datetime FROM q_ext) a CROSS JOIN q_ext e "
    "LEFT JOIN q_mean m ON m.station = s.station AND m.datetime = a.datetime), "
    f"{filled_sql('q_grid', 'q_fill')}, q_size AS (SELECT max(t) + 1 AS n FROM q_fill), "
    f"q_b AS (SELECT 'test' AS split, n - {N_TEST} - {L_SEQ} AS b1, n AS b2 FROM q_size), {starts_sql(L_SEQ + L_PRED, 'q_fill', 'q_b')}, "
    f"{windows_sql(L_SEQ, L_LABEL, L_PRED, 'q_fill', 'tw')}"
)


def week_windows(spark, d):
    """Test windows of a week, which reach back by one lookback."""
    r = E.type_readings(spark, d, 900)
    limits = grid.extent_of(r)
    table = fills.fill_linear(grid.regular_grid(r, 900, limits=limits, carry=True))
    return windows.windows(table, L_SEQ, L_LABEL, L_PRED, split.lookback_ranges(limits.steps(900), L_SEQ).only("test"))


def damped_model():
    """Each point is a share of the one a day before plus a constant."""
    return P.forecaster("linear_token", [*(DAMP * np.eye(L_TOKEN)).tolist(), [LEVEL] * L_TOKEN])


DAMPED = (
    f"roll AS (SELECT station, s_begin, y, 0 AS k, x[{L_SEQ - L_TOKEN + 1}:] AS token, CAST([] AS DOUBLE[]) AS forecast FROM tw UNION ALL "
    "SELECT station, s_begin, y, k + 1, next, list_concat(forecast, next) FROM (SELECT *, list_transform(token, lambda v: v * "
    f"{DAMP} + {LEVEL}) AS next FROM roll WHERE k < {L_STEPS}) q)"
)


@query(
    "t01_fed_back_rollout",
    f"WITH RECURSIVE {QUARTERS}, {DAMPED} SELECT station, s_begin, {arr('list_transform(forecast, lambda v: round(v, 9))')} AS forecast FROM roll WHERE k = {L_STEPS}",
)
def _(spark, d):
    out = P.rollout(week_windows(spark, d), damped_model(), L_PRED, L_TOKEN)
    # The noise of two ways to multiply must not decide how a half is rounded in the digest.
    return out.select(*KEYS, F.transform("forecast", lambda v: F.round(v, 9)).alias("forecast"))


@query(
    "t03_fed_back_horizons",
    f"WITH RECURSIVE {QUARTERS}, {DAMPED}, cells AS (SELECT forecast, y, unnest(range({L_PRED})) AS step FROM roll WHERE k = {L_STEPS}), "
    f"fr AS (SELECT step, forecast[step + 1] AS pred, y[{L_LABEL} + step + 1] AS truth FROM cells) "
    f"SELECT CAST(h.h AS INTEGER) AS horizon, count(*) AS rows, {r6('avg(abs(pred - truth))')} AS mae, {r6('avg((pred - truth) * (pred - truth))')} AS mse "
    f"FROM fr JOIN (SELECT unnest([{', '.join(str(L_TOKEN * k) for k in range(1, L_STEPS + 1))}]) AS h) h ON fr.step < h.h GROUP BY h.h",
)
def _(spark, d):
    horizons = [L_TOKEN * k for k in range(1, L_STEPS + 1)]
    return P.evaluate_horizons(week_windows(spark, d), damped_model(), horizons, L_TOKEN, KEYS)


@query(
    "t09_fed_back_user_forecaster",
    f"WITH RECURSIVE {QUARTERS}, roll AS (SELECT station, s_begin, 0 AS k, x, CAST([] AS DOUBLE[]) AS forecast FROM tw UNION ALL "
    f"SELECT station, s_begin, k + 1, list_concat(x[{L_TOKEN + 1}:], next), list_concat(forecast, next) FROM (SELECT *, list_transform(range({L_TOKEN}), lambda i: m) AS next FROM "
    f"(SELECT *, list_sum(x) / len(x) AS m FROM roll WHERE k < {L_STEPS}) q) q) SELECT station, s_begin, {arr('forecast')} AS forecast FROM roll WHERE k = {L_STEPS}",
)
def _(spark, d):
    model = P.forecaster("lookback_mean", L_TOKEN)
    return P.rollout(week_windows(spark, d), model, L_PRED, L_TOKEN).select(*KEYS, "forecast")


# ---- fitted forecaster ---------------------------------------------------------

SHIFT = SEQ - TOKEN
TRAIN_WINDOWS = (
    f"{FILLED}, {bounds_sql()}, {starts_sql(SEQ + TOKEN)}, {windows_sql(SEQ, SHIFT, TOKEN)}, trw AS (SELECT * FROM win WHERE split = 'train')"
)


def train_windows(spark, d):
    return hour_windows(spark, d, only=["train"], seq=SEQ, label=SHIFT, pred=TOKEN)


def train_pairs(spark, d):
    return P.supervision_pairs(train_windows(spark, d), SEQ, SHIFT, TOKEN)


@query(
    "t11_supervision_pairs",
    f"WITH {TRAIN_WINDOWS}, p AS (SELECT station, split, s_begin, x, y, unnest(range({SEQ // TOKEN})) AS pos FROM trw) "
    f"SELECT station, split, s_begin, CAST(pos AS INTEGER) AS pos, {arr(f'x[pos * {TOKEN} + 1 : pos * {TOKEN} + {TOKEN}]')} AS token_in, "
    f"{arr(f'y[pos * {TOKEN} + 1 : pos * {TOKEN} + {TOKEN}]')} AS token_out FROM p",
)
def _(spark, d):
    return train_pairs(spark, d)


@query(
    "t12_token_losses",
    f"WITH {TRAIN_WINDOWS}, p AS (SELECT x, y, unnest(range(1, {SEQ} + 1)) AS i FROM trw), "
    "e AS (SELECT i, power(x[i] - y[i], 2) AS sq FROM p) "
    f"SELECT {r6('avg(sq)')} AS all_token_mse, {r6(f'avg(sq) FILTER (i > {SHIFT})')} AS last_token_mse FROM e",
)
def _(spark, d):
    return P.last_token_loss(train_windows(spark, d), P.forecaster("last_token", TOKEN), TOKEN)


# The fit with tokens of one point, whose two equations are solved by hand from sums of whole steps.
UNIT = f"CAST({P.FIT_STEP!r} AS DOUBLE)"
SOLVED = "fit AS (SELECT (sxy * n - sx * sy) / (sxx * n - sx * sx) AS a, (sxx * sy - sx * sxy) / (sxx * n - sx * sx) AS c FROM sums)"


def fit_sql(source: str, times: str = "1") -> str:
    """Slope ``a`` and constant ``c`` from pairs of whole numbers ``x, y`` that count ``times`` each."""
    part = lambda e, unit: f"CAST(sum({e} * {times}) AS DOUBLE) * {unit}"
    return (
        f"sums AS (SELECT CAST(sum({times}) AS DOUBLE) AS n, {part('x', UNIT)} AS sx, {part('y', UNIT)} AS sy, "
        f"{part('x * x', f'({UNIT} * {UNIT})')} + {P.RIDGE} AS sxx, {part('x * y', f'({UNIT} * {UNIT})')} AS sxy FROM {source}), {SOLVED}"
    )


WHOLE = lambda v: f"CAST(round({v} / {UNIT}) AS HUGEINT)"
# A pair of neighbours counts once for each training window that holds both.
FIT_ONE = (
    f"fit_w AS (SELECT f.station, f.t, {WHOLE('f.target')} AS x, {WHOLE('g.target')} AS y, "
    f"least(f.t + 1, {SEQ}, (SELECT {N_TRAIN} FROM size) - 1 - f.t, (SELECT {N_TRAIN} FROM size) - {SEQ}) AS times "
    f"FROM filled f JOIN filled g ON g.station = f.station AND g.t = f.t + 1), fit_p AS (SELECT * FROM fit_w WHERE times > 0), {fit_sql('fit_p', 'times')}"
)


def _fed_back(start: str, steps: int, source: str, keys: str = "station, s_begin") -> str:
    """Points of a rollout of the fitted map, step by step: each one from the one before."""
    return (
        f"roll AS (SELECT {keys}, 0 AS step, a * {start} + c AS pred FROM {source}, fit UNION ALL "
        f"SELECT {keys}, step + 1, a * pred + c FROM roll, fit WHERE step < {steps - 1})"
    )


def one_point_pairs(spark, d):
    return P.supervision_pairs(hour_windows(spark, d, only=["train"], seq=SEQ, label=SEQ - 1, pred=1), SEQ, SEQ - 1, 1)


@query(
    "t07_linear_forecaster",
    f"WITH RECURSIVE {TEST_WINDOWS}, {FIT_ONE}, {_fed_back(f'x[{SEQ}]', PRED, 'tw')}, "
    f"fr AS (SELECT r.pred, w.y[{LABEL} + 1 + r.step] AS truth FROM roll r JOIN tw w USING (station, s_begin)) SELECT {BUNDLE} FROM fr",
)
def _(spark, d):
    weights = P.fit_linear_token(one_point_pairs(spark, d), 1)
    rows = P.forecast_rows(P.rollout(test_windows(spark, d), P.forecaster("linear_token", weights), PRED, 1), PRED, KEYS)
    return M.bundle(rows)


@query(
    "t07_normal_equations",
    f"WITH {FILLED}, pairs AS (SELECT greatest({N_TRAIN} - {SEQ + TOKEN} + 1, 0) * {SEQ // TOKEN} * (SELECT count(DISTINCT station) FROM filled) AS pairs FROM size) "
    f"SELECT CAST({TOKEN} AS INTEGER) AS token_len, CAST(pairs AS BIGINT) AS pairs, true AS solved FROM pairs",
)
def _(spark, d):
    """The fit with whole tokens: its equations hold to a billionth."""
    sums = P.normal_sums(train_pairs(spark, d), TOKEN)
    left, right = P.normal_equations(sums, TOKEN)
    weights = np.linalg.solve(left, right)
    off = float(np.abs(left @ weights - right).max() / np.abs(right).max())
    return spark.createDataFrame([(TOKEN, sums[TOKEN][TOKEN], off < 1e-9)], "token_len int, pairs long, solved boolean")


WEEK = 7 * 86_400
# Weekly series of another table, shipped quantity per supplier, and their test windows.
WEEKLY = (
    f"{SHIP}, weekly AS (SELECT CAST(to_timestamp(CAST(floor(epoch(datetime) / {WEEK}) * {WEEK} AS BIGINT)) AS TIMESTAMP) AS datetime, station, target FROM ship), "
    "wk_ext AS (SELECT min(datetime) AS lo, max(datetime) AS hi FROM weekly), "
    "wk_mean AS (SELECT station, datetime, avg(target) AS target FROM weekly GROUP BY station, datetime), "
    "wk_grid AS (SELECT s.station, CAST(date_diff('day', e.lo, a.datetime) // 7 AS BIGINT) AS t, a.datetime, m.target FROM (SELECT DISTINCT station FROM weekly) s "
    "CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS datetime FROM wk_ext) a CROSS JOIN wk_ext e "
    "LEFT JOIN wk_mean m ON m.station = s.station AND m.datetime = a.datetime), "
    f"{filled_sql('wk_grid', 'wk_fill')}, wk AS (SELECT station, t, coalesce(target, 0.0) AS target FROM wk_fill), "
    "wk_size AS (SELECT max(t) + 1 AS n FROM wk), "
    f"wk_b AS (SELECT 'test' AS split, {N_TRAIN} + {N_VAL} AS b1, n AS b2 FROM wk_size), "
    f"{starts_sql(SEQ + TOKEN, 'wk', 'wk_b')}, {windows_sql(SEQ, LABEL, TOKEN, 'wk', 'wk_win')}"
)
SHARES = (
    f"count(*) AS rows, {r6('avg(200 * abs(pred - truth) / (abs(pred) + abs(truth) + 1e-8))')} AS smape, "
    f"{r6('avg(abs(100 * (pred - truth) / (truth + 1e-8)))')} AS mape"
)


def weekly_supplier_windows(spark, d):
    r = E.shipment_readings(spark, d).withColumn("datetime", floor_time("datetime", WEEK))
    limits = grid.extent_of(r)
    ranges = split.ratio_ranges(limits.steps(WEEK)).only("test")
    span = ranges.span()
    filled = fills.fill_linear(grid.regular_grid(r, WEEK, limits=limits, carry=True, span=span), default=0.0)
    return windows.windows(filled, SEQ, LABEL, TOKEN, ranges, first=span[0])


@query(
    "t04_zero_shot_task",
    f"WITH RECURSIVE {FILLED}, {FIT_ONE}, {WEEKLY}, {_fed_back(f'x[{SEQ}]', TOKEN, 'wk_win')}, "
    f"fr AS (SELECT r.pred, w.y[{LABEL} + 1 + r.step] AS truth FROM roll r JOIN wk_win w USING (station, s_begin)) SELECT {SHARES} FROM fr",
)
def _(spark, d):
    return P.task("zero_shot_forecast")(one_point_pairs(spark, d), weekly_supplier_windows(spark, d), 1, TOKEN, KEYS)


# Fitted on windows of their own scale; each step is taken on the window's scale too, which the points fed back change in turn.
WINDOW_SCALE = (
    f"SELECT *, sqrt(list_sum(list_transform(x, lambda v: (v - m) * (v - m))) / len(x) + {V.WINDOW_VAR_EPS}) AS s FROM "
    "(SELECT *, list_sum(x) / len(x) AS m FROM {0}) q"
)
FIT_SCALED = (
    f"tr_b AS (SELECT * FROM bounds WHERE split = 'train'), {starts_sql(SEQ + 1, bounds='tr_b', name='tr_starts')}, "
    f"tr_w AS (SELECT s.station, s.s_begin, list(f.target ORDER BY f.t) AS w FROM tr_starts s JOIN filled f ON f.station = s.station "
    f"AND f.t >= s.s_begin AND f.t < s.s_begin + {SEQ + 1} GROUP BY ALL), tr_x AS (SELECT *, w[1:{SEQ}] AS x FROM tr_w), "
    f"tr_s AS ({WINDOW_SCALE.format('tr_x')}), tr_p AS (SELECT w, m, s, unnest(range(1, {SEQ} + 1)) AS i FROM tr_s), "
    f"fit_p AS (SELECT {WHOLE('((w[i] - m) / s)')} AS x, {WHOLE('((w[i + 1] - m) / s)')} AS y FROM tr_p), {fit_sql('fit_p')}"
)
SCALED_STEPS = (
    "roll AS (SELECT station, s_begin, 0 AS step, x, CAST(NULL AS DOUBLE) AS pred FROM wk_win UNION ALL "
    "SELECT station, s_begin, step + 1, list_concat(x[2:], [next]), next FROM (SELECT station, s_begin, step, x, (a * (x[len(x)] - m) / s + c) * s + m AS next FROM "
    f"({WINDOW_SCALE.format(f'(SELECT * FROM roll WHERE step < {TOKEN}) r')}) q, fit) q)"
)


@query(
    "j11_target_domain_swap",
    f"WITH RECURSIVE {FILLED}, {bounds_sql()}, {FIT_SCALED}, {WEEKLY}, {SCALED_STEPS}, "
    f"fr AS (SELECT r.pred, w.y[{LABEL} + r.step] AS truth FROM roll r JOIN wk_win w USING (station, s_begin) WHERE r.step > 0) "
    f"SELECT count(*) AS rows, {r6('avg(200 * abs(pred - truth) / (abs(pred) + abs(truth) + 1e-8))')} AS smape, {r6('avg(abs(pred - truth))')} AS mae FROM fr",
)
def _(spark, d):
    own = hour_windows(spark, d, only=["train"], seq=SEQ, label=SEQ - 1, pred=1)
    scale = V.instance_norm("x")
    scaled = own.withColumn("m", scale["mean"]).withColumn("s", scale["sd"])
    scaled = scaled.withColumns({c: V.normalise(F.col(c), F.col("m"), F.col("s")) for c in ("x", "y")}).drop("m", "s")
    weights = P.fit_linear_token(P.supervision_pairs(scaled, SEQ, SEQ - 1, 1), 1)
    model = P.normalised(P.forecaster("linear_token", weights))
    rows = P.forecast_rows(P.rollout(weekly_supplier_windows(spark, d), model, TOKEN, 1), TOKEN, KEYS)
    return M.aggregate(rows, rows=F.count(F.lit(1)), smape=M.smape(), mae=M.mae())


# ---- anomaly flags -------------------------------------------------------------

FLAGS = "fl AS (SELECT event_id, CAST(value > 20 AS INTEGER) AS gt, CAST(user_id % 10 < 3 AS INTEGER) AS pred FROM events)"


def _flags(spark, d):
    return E.table(spark, d, "events").select(
        "event_id", (F.col("value") > 20).cast("int").alias("gt"), (F.col("user_id") % 10 < 3).cast("int").alias("pred")
    )


ADJUST = (
    f"WITH {FLAGS}, z AS (SELECT *, sum(1 - gt) OVER (ORDER BY event_id) AS run FROM fl) "
    "SELECT event_id, gt, pred, CASE WHEN gt = 1 THEN max(CASE WHEN gt = 1 THEN pred END) OVER (PARTITION BY run) ELSE pred END AS adjusted FROM z"
)


@query("w26_point_adjust", ADJUST)
def _(spark, d):
    return anomaly.point_adjust(_flags(spark, d), "event_id")


@query(
    "w26_point_adjust_strict",
    f"SELECT event_id, gt, pred, CASE WHEN event_id = (SELECT min(event_id) FROM events) THEN pred ELSE adjusted END AS adjusted FROM ({ADJUST})",
)
def _(spark, d):
    return anomaly.point_adjust(_flags(spark, d), "event_id", skip_first=True)
