"""Multi-step forecasts over window tables, and the four evaluation tasks.

A forecaster maps a table with a lookback array ``x`` to the same table with one
predicted token ``token`` per row.  The rollout feeds that token back; every step
is an expression on the row, so a rollout of any length is one map-only stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions import vectors as V
from gridcast.operators import marks as K
from gridcast.plans import metrics as M

Forecaster = Callable[[DataFrame], DataFrame]
RIDGE = 1e-3


# ---- forecasters ---------------------------------------------------------------


def last_value(token_len: int) -> Forecaster:
    return lambda df: df.withColumn("token", F.array_repeat(F.element_at("x", -1), token_len))


def last_token(token_len: int) -> Forecaster:
    return lambda df: df.withColumn("token", V.tail(F.col("x"), token_len))


def seasonal(token_len: int, freq: int) -> Forecaster:
    """Repeats the last season; a token longer than the season wraps around."""

    def run(df: DataFrame) -> DataFrame:
        season = V.tail(F.col("x"), freq)
        copies = math.ceil(token_len / freq)
        repeated = F.flatten(F.array_repeat(season, copies))
        return df.withColumn("token", V.head(repeated, token_len))

    return run


def marked_persistence(token_len: int, weight: float) -> Forecaster:
    """Last token shifted by ``weight`` times the mean of the newest mark vector."""

    def run(df: DataFrame) -> DataFrame:
        newest = F.element_at("x_mark", -1)
        shift = F.lit(weight) * V.array_mean(F.transform(newest, lambda v: v.cast("double")))
        return df.withColumn("token", F.transform(V.tail(F.col("x"), token_len), lambda v: v + shift))

    return run


class LinearToken:
    """Next token = affine map of the last token; ``weights`` is (token_len + 1) rows by token_len.

    One matrix product per Arrow batch; the weights have a fixed size.  As the map of a map is affine
    again, a rollout of any number of steps is one product too (``horizon``).
    """

    def __init__(self, weights: Sequence[Sequence[float]]):
        self.weights = np.asarray(weights, dtype=float)
        self.token_len = self.weights.shape[1]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("token", self._times(self.weights)(V.tail(F.col("x"), self.token_len)))

    def horizon(self, steps: int) -> Column:
        """All points of ``steps`` tokens that are fed back one after the other."""
        return self._times(affine_powers(self.weights, steps))(V.tail(F.col("x"), self.token_len))

    @staticmethod
    def _times(weights: np.ndarray) -> Callable[[Column], Column]:
        @F.pandas_udf("array<double>")
        def product(newest: pd.Series) -> pd.Series:
            if not len(newest):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.stack(newest.to_numpy()) @ weights[:-1] + weights[-1]))

        return product


class ScaledLinearToken:
    """A linear token taken on each lookback's own scale, which the points fed back change in turn: a loop over steps per Arrow batch."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.token_len = weights, weights.shape[1]

    def horizon(self, steps: int) -> Column:
        weights, k = self.weights, self.token_len

        @F.pandas_udf("array<double>")
        def roll(lookback: pd.Series) -> pd.Series:
            if not len(lookback):
                return pd.Series([], dtype=object)
            x = np.stack(lookback.to_numpy())
            out = []
            for _ in range(steps):
                mean = x.mean(1, keepdims=True)
                sd = np.sqrt(x.var(1, keepdims=True) + V.WINDOW_VAR_EPS)
                token = (((x[:, -k:] - mean) / sd) @ weights[:-1] + weights[-1]) * sd + mean
                out.append(token)
                x = np.concatenate([x[:, k:], token], axis=1)
            return pd.Series(list(np.concatenate(out, axis=1)))

        return roll(F.col("x"))

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("token", self.horizon(1))


def affine_powers(weights: np.ndarray, steps: int) -> np.ndarray:
    """The maps of 1, 2, … ``steps`` steps side by side, by doubling: what follows m steps is the first m steps of their end."""
    k = weights.shape[1]
    done = weights
    while done.shape[1] < k * steps:
        last = done[:, -k:]
        more = last @ done[:-1]
        more[-1] += done[-1]
        done = np.concatenate([done, more], axis=1)
    return done[:, : k * steps]


def linear_token(weights: Sequence[Sequence[float]]) -> Forecaster:
    return LinearToken(weights)


FORECASTERS: dict[str, Callable[..., Forecaster]] = {
    "last_value": last_value,
    "last_token": last_token,
    "seasonal": seasonal,
    "marked_persistence": marked_persistence,
    "linear_token": linear_token,
}


def register(name: str, build: Callable[..., Forecaster]) -> None:
    """Adds a forecaster by name; ``build`` may wrap a user's pandas UDF."""
    FORECASTERS[name] = build


def forecaster(name: str, *args, **kwargs) -> Forecaster:
    if name not in FORECASTERS:
        raise ValueError(f"unknown forecaster {name!r}; known: {sorted(FORECASTERS)}")
    return FORECASTERS[name](*args, **kwargs)


# ---- fitting -------------------------------------------------------------------


def require_token_shift(seq_len: int, label_len: int, token_len: int) -> None:
    if label_len != seq_len - token_len:
        raise ValueError(f"label_len must be seq_len - token_len = {seq_len - token_len}, got {label_len}")


def supervision_pairs(windows: DataFrame, seq_len: int, label_len: int, token_len: int) -> DataFrame:
    """``(…, pos, token_in, token_out)``: each lookback token and the one after it."""
    require_token_shift(seq_len, label_len, token_len)
    count = seq_len // token_len
    pairs = F.arrays_zip(
        V.tokens(F.col("x"), token_len, count).alias("token_in"), V.tokens(F.col("y"), token_len, count).alias("token_out")
    )
    keys = [c for c in windows.columns if c not in ("x", "y")]
    return windows.select(*keys, F.posexplode(pairs).alias("pos", "_pair")).select(
        *keys, "pos", F.col("_pair.token_in").alias("token_in"), F.col("_pair.token_out").alias("token_out")
    )


# Values are taken to whole steps of this size in a fit, so that sums are exact and do not depend on their order.
FIT_STEP = 2.0**-30
# Whole numbers in three parts of so many bits; products of parts over so many rows stay exact in doubles.
PART_BITS, PART_ROWS = 20, 1 << 12
# Bits of the lower part of a sum.
LOW_BITS = 60


def exact_gram(rows: np.ndarray) -> list[list[int]]:
    """Sums of products of all pairs of columns of whole numbers below 2^60, exact."""
    total = [[0] * rows.shape[1] for _ in range(rows.shape[1])]
    sign, size = np.sign(rows), np.abs(rows)
    parts = [(sign * ((size >> (PART_BITS * p)) & ((1 << PART_BITS) - 1))).astype(float) for p in range(3)]
    for begin in range(0, len(rows), PART_ROWS):
        cut = [p[begin : begin + PART_ROWS] for p in parts]
        for a in range(3):
            for b in range(3):
                shift = PART_BITS * (a + b)
                for i, row in enumerate((cut[a].T @ cut[b]).tolist()):
                    for j, v in enumerate(row):
                        total[i][j] += int(v) << shift
    return total


def normal_sums(pairs: DataFrame, token_len: int, step: float = FIT_STEP) -> list[list[int]]:
    """Sums of products of (token_in, 1, token_out), in whole steps; every pair counts.

    Tasks give (2 * token_len + 1)² sums each, as decimals in two parts, which add up to the same whole numbers in any order.
    """
    width = 2 * token_len + 1

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [[0] * width for _ in range(width)]
        for batch in batches:
            if len(batch):
                x, y = (np.rint(np.stack(batch[c].to_numpy()) / step) for c in ("token_in", "token_out"))
                rows = np.column_stack([x, np.ones(len(batch)), y]).astype(np.int64)
                if np.abs(rows).max() >= 1 << (3 * PART_BITS):
                    raise ValueError("values are too large for exact sums: take a larger step")
                total = [[u + v for u, v in zip(a, b, strict=True)] for a, b in zip(total, exact_gram(rows), strict=True)]
        cells = [(i, j, str(v >> LOW_BITS), str(v & ((1 << LOW_BITS) - 1))) for i, row in enumerate(total) for j, v in enumerate(row)]
        yield pd.DataFrame(cells, columns=["i", "j", "high", "low"])

    sums = pairs.select("token_in", "token_out").mapInPandas(share, "i long, j long, high string, low string")
    added = [F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in ("high", "low")]
    table = [[0] * width for _ in range(width)]
    for r in sums.groupBy("i", "j").agg(*added).collect():
        table[r["i"]][r["j"]] = (int(r["high"]) << LOW_BITS) + int(r["low"])
    return table


def fit_linear_token(pairs: DataFrame, token_len: int, ridge: float = RIDGE, step: float = FIT_STEP) -> np.ndarray:
    """Ridge map from a token to the next one, fitted over any number of pairs.

    The sums of the normal equations are whole numbers, so the fit is the same whatever the partitioning.
    """
    left, right = normal_equations(normal_sums(pairs, token_len, step), token_len, ridge, step)
    return np.linalg.solve(left, right)


def normal_equations(sums: list[list[int]], token_len: int, ridge: float = RIDGE, step: float = FIT_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Both sides of the equations of a ridge fit; the constant is not held back."""
    k = token_len + 1
    units = [step] * token_len + [1.0] + [step] * token_len
    table = np.array([[v * (units[i] * units[j]) for j, v in enumerate(row)] for i, row in enumerate(sums)], dtype=float)
    penalty = ridge * np.eye(k)
    penalty[-1, -1] = 0.0
    return table[:k, :k] + penalty, table[:k, k:]


# ---- rollout -------------------------------------------------------------------


def rollout_steps(pred_len: int, token_len: int) -> int:
    return math.ceil(pred_len / token_len)


def rollout(windows: DataFrame, model: Forecaster, pred_len: int, token_len: int, with_marks: bool = False) -> DataFrame:
    """Adds ``forecast`` with exactly ``pred_len`` points; an affine forecaster takes one product for all steps."""
    if isinstance(model, (LinearToken, ScaledLinearToken)) and model.token_len == token_len:
        return windows.withColumn("forecast", V.head(model.horizon(rollout_steps(pred_len, token_len)), pred_len))
    state = windows.withColumn("_x0", F.col("x")).withColumn("_out", F.array().cast("array<double>"))
    if with_marks:
        state = state.withColumn("_m0", F.col("x_mark"))
    for step in range(rollout_steps(pred_len, token_len)):
        if step and with_marks:
            state = state.withColumn("x_mark", K.feed_future_mark(F.col("x_mark"), F.col("y_mark"), step))
        state = model(state)
        state = state.withColumn("_out", F.concat("_out", "token")).withColumn(
            "x", F.concat(F.slice("x", F.lit(token_len + 1), F.size("x") - token_len), F.col("token"))
        )
    done = state.withColumn("forecast", V.head(F.col("_out"), pred_len)).withColumn("x", F.col("_x0"))
    if with_marks:
        done = done.withColumn("x_mark", F.col("_m0")).drop("_m0")
    return done.drop("_x0", "_out", "token")


def normalised(model: Forecaster) -> Forecaster:
    """Runs ``model`` on the lookback with its own mean and deviation removed."""
    if isinstance(model, LinearToken):
        return ScaledLinearToken(model.weights)

    def run(df: DataFrame) -> DataFrame:
        mean = V.array_mean(F.col("x"))
        scaled = df.withColumn("_raw", F.col("x")).withColumn("_mean", mean)
        scaled = scaled.withColumn("_sd", F.sqrt(V.array_var(F.col("x"), F.col("_mean")) + F.lit(V.WINDOW_VAR_EPS)))
        scaled = scaled.withColumn("x", V.normalise(F.col("x"), F.col("_mean"), F.col("_sd")))
        out = model(scaled)
        return (
            out.withColumn("token", V.denormalise(F.col("token"), F.col("_mean"), F.col("_sd")))
            .withColumn("x", F.col("_raw"))
            .drop("_raw", "_mean", "_sd")
        )

    return run


def forecast_rows(forecasts: DataFrame, pred_len: int, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``(keys, step, pred, true)``: forecast points beside the last ``pred_len`` points of ``y``."""
    both = F.arrays_zip(F.col("forecast").alias("pred"), V.tail(F.col("y"), pred_len).alias("true"))
    return forecasts.select(*keys, *extra, F.posexplode(both).alias("step", "_v")).select(
        *keys, *extra, "step", F.col("_v.pred").alias("pred"), F.col("_v.true").alias("true")
    )


def align(forecast: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forecast rows with the truth of the same key and step."""
    return forecast.join(truth, [*keys, "step"])


# ---- evaluation tasks ----------------------------------------------------------


def evaluate_long(windows: DataFrame, model: Forecaster, pred_len: int, token_len: int, keys: Sequence[str]) -> DataFrame:
    """Standard five metrics over all test windows."""
    return M.bundle(forecast_rows(rollout(windows, model, pred_len, token_len), pred_len, keys))


def evaluate_horizons(
    windows: DataFrame, model: Forecaster, horizons: Sequence[int], token_len: int, keys: Sequence[str]
) -> DataFrame:
    """Several horizons from one rollout to the longest of them.

    A step belongs to every horizon beyond it; steps are summed up first, so only
    one row per step is repeated.
    """
    longest = max(horizons)
    rows = forecast_rows(rollout(windows, model, longest, token_len), longest, keys)
    err = F.col("pred") - F.col("true")
    per_step = rows.groupBy("step").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs(err)).alias("_abs"), F.sum(err * err).alias("_sq")
    )
    opened = per_step.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in sorted(horizons)])))
    return (
        opened.where(F.col("step") < F.col("horizon"))
        .groupBy("horizon")
        .agg(
            F.sum("_n").alias("rows"),
            (F.sum("_abs") / F.sum("_n")).alias("mae"),
            (F.sum("_sq") / F.sum("_n")).alias("mse"),
        )
    )


def evaluate_zero_shot(
    source_pairs: DataFrame, target_windows: DataFrame, token_len: int, pred_len: int, keys: Sequence[str], ridge: float = RIDGE
) -> DataFrame:
    """Fits on one collection and scores another."""
    model = linear_token(fit_linear_token(source_pairs, token_len, ridge))
    rows = forecast_rows(rollout(target_windows, model, pred_len, token_len), pred_len, keys)
    return M.aggregate(rows, rows=F.count(F.lit(1)), smape=M.smape(), mape=M.mape_percent())


def evaluate_in_context(
    zero_shot: DataFrame, in_context: DataFrame, model: Forecaster, token_len: int, keys: Sequence[str]
) -> DataFrame:
    """Scores plain and prompted windows of the same series side by side (column ``mode``)."""
    both = zero_shot.select(*keys, "x", "y").withColumn("mode", F.lit("zero_shot")).unionByName(
        in_context.select(*keys, "x", "y").withColumn("mode", F.lit("in_context"))
    )
    rows = forecast_rows(rollout(both, model, token_len, token_len), token_len, keys, extra=["mode"])
    return M.aggregate(rows, ["mode"], rows=F.count(F.lit(1)), smape=M.smape(), mape=M.mape_percent())


def evaluate_short(last_windows: DataFrame, model: Forecaster, token_len: int, keys: Sequence[str]) -> DataFrame:
    """One forecast per series from its last window: ``(keys, forecast)``."""
    return rollout(last_windows, model, token_len, token_len).select(*keys, "forecast")


TASKS: dict[str, Callable[..., DataFrame]] = {
    "long_term_forecast": evaluate_long,
    "short_term_forecast": evaluate_short,
    "zero_shot_forecast": evaluate_zero_shot,
    "in_context_forecast": evaluate_in_context,
}


def task(name: str) -> Callable[..., DataFrame]:
    """Task by name; an unknown name means long-term forecasting."""
    return TASKS.get(name, evaluate_long)


def last_token_loss(windows: DataFrame, model: Forecaster, token_len: int) -> DataFrame:
    """Squared error over all next tokens and over the last one only."""
    count = F.floor(F.size("x") / token_len).cast("int")
    known = windows.select(F.col("x").alias("_all"), "y", count.alias("_count"))
    per_token = known.select(
        "_count", F.posexplode(V.tokens(F.col("_all"), token_len)).alias("pos", "x"), "y"
    )
    scored = model(per_token)
    truth = F.slice("y", F.col("pos") * token_len + 1, F.lit(token_len))
    sq = V.array_sum(F.zip_with("token", truth, lambda a, b: (a - b) * (a - b)))
    rows = scored.select(sq.alias("_sq"), (F.col("pos") == F.col("_count") - 1).alias("_last"))
    return rows.agg(
        (F.sum("_sq") / (F.count(F.lit(1)) * token_len)).alias("all_token_mse"),
        (F.sum(F.when(F.col("_last"), F.col("_sq"))) / (F.count_if("_last") * token_len)).alias("last_token_mse"),
    )


def ablation(windows: DataFrame, model: Forecaster, pred_len: int, token_len: int) -> DataFrame:
    """Mean absolute change of the forecast when mark halves, or all marks, are zeroed."""

    both = {
        "none": lambda m: K.keep_half(K.keep_half(m, True), False),
        "time": lambda m: K.keep_half(m, True),
        "weather": lambda m: K.keep_half(m, False),
    }
    out = rollout(windows, model, pred_len, token_len, with_marks=True).withColumnRenamed("forecast", "_full")
    for name, change in both.items():
        saved = out.withColumn("_xm", F.col("x_mark")).withColumn("_ym", F.col("y_mark"))
        saved = saved.withColumn("x_mark", change(F.col("x_mark"))).withColumn("y_mark", change(F.col("y_mark")))
        out = (
            rollout(saved, model, pred_len, token_len, with_marks=True)
            .withColumnRenamed("forecast", f"_{name}")
            .withColumn("x_mark", F.col("_xm"))
            .withColumn("y_mark", F.col("_ym"))
            .drop("_xm", "_ym")
        )
    gaps = [
        F.avg(V.array_mean(F.zip_with("_full", f"_{n}", lambda a, b: F.abs(a - b)))).alias(f"full_vs_{n}") for n in both
    ]
    return out.agg(*gaps)
