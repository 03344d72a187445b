"""Forecasters, rollouts, metrics and anomaly flags against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.operators import anomaly
from gridcast.plans import forecasting as P
from gridcast.plans import metrics as M


@pytest.fixture
def windows(spark):
    rows = [("a", s, [float(s + i) for i in range(12)], [float(s + 8 + i) for i in range(11)]) for s in range(30)]
    return spark.createDataFrame(rows, "station string, s_begin long, x array<double>, y array<double>")


def test_rollout_trims_to_horizon(windows):
    out = P.rollout(windows, P.forecaster("last_token", 4), 7, 4).where("s_begin = 0").first()
    assert out["forecast"] == [8.0, 9.0, 10.0, 11.0, 8.0, 9.0, 10.0]
    assert out["x"] == [float(i) for i in range(12)]


def test_seasonal_wraps(windows):
    out = P.rollout(windows, P.forecaster("seasonal", 4, 3), 8, 4).where("s_begin = 0").first()
    assert out["forecast"][:4] == [9.0, 10.0, 11.0, 9.0]


def test_supervision_needs_a_shift_of_one_token(windows):
    with pytest.raises(ValueError):
        P.supervision_pairs(windows, 12, 6, 4)


def test_linear_forecaster_matches_numpy(spark):
    rng = np.random.default_rng(0)
    series = np.cumsum(rng.normal(size=400))
    tok, seq = 3, 12
    rows = [
        ("a", s, series[s : s + seq].tolist(), series[s + tok : s + seq + tok].tolist()) for s in range(380 - seq)
    ]
    df = spark.createDataFrame(rows, "station string, s_begin long, x array<double>, y array<double>").repartition(5)
    w = P.fit_linear_token(P.supervision_pairs(df, seq, seq - tok, tok), tok, ridge=0.5)
    x = np.array([r[2][i : i + tok] for r in rows for i in range(0, seq, tok)])
    y = np.array([r[3][i : i + tok] for r in rows for i in range(0, seq, tok)])
    design = np.column_stack([x, np.ones(len(x))])
    pen = 0.5 * np.eye(tok + 1)
    pen[-1, -1] = 0
    assert w == pytest.approx(np.linalg.solve(design.T @ design + pen, design.T @ y), rel=1e-8)
    got = P.rollout(df, P.linear_token(w), 2 * tok, tok).where("s_begin = 7").first()["forecast"]
    one = np.array(rows[7][2][-tok:]) @ w[:-1] + w[-1]
    assert got == pytest.approx(np.concatenate([one, one @ w[:-1] + w[-1]]))


def test_unknown_names():
    with pytest.raises(ValueError):
        P.forecaster("no such model")
    assert P.task("no such task") is P.evaluate_long


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(10, 4, (50, 6))
    p = t + rng.normal(0, 1, (50, 6))
    data = [(i, j, float(p[i, j]), float(t[i, j])) for i in range(50) for j in range(6)]
    return spark.createDataFrame(data, "id int, step int, pred double, true double"), p, t


def test_metrics(rows):
    df, p, t = rows
    got = M.aggregate(
        df, mae=M.mae(), mse=M.mse(), rmse=M.rmse(), mape=M.mape(), mspe=M.mspe(), rse=M.rse(), smape=M.smape()
    ).first()
    assert got["mae"] == pytest.approx(np.abs(p - t).mean())
    assert got["mse"] == pytest.approx(((p - t) ** 2).mean())
    assert got["rmse"] == pytest.approx(np.sqrt(((p - t) ** 2).mean()))
    assert got["mape"] == pytest.approx(np.abs((p - t) / t).mean())
    assert got["mspe"] == pytest.approx((((p - t) / t) ** 2).mean())
    assert got["rse"] == pytest.approx(np.sqrt(((t - p) ** 2).sum()) / np.sqrt(((t - t.mean()) ** 2).sum()))
    assert got["smape"] == pytest.approx((200 * np.abs(p - t) / (np.abs(p) + np.abs(t) + 1e-8)).mean())


def test_step_correlation(rows):
    df, p, t = rows
    a, b = t - t.mean(0), p - p.mean(0)
    want = ((a * b).sum(0) / np.sqrt((a**2 * b**2).sum(0))).mean()
    assert M.step_correlation(df).first()["corr"] == pytest.approx(want)


def test_masked_metrics_by_hand(spark):
    data = [(2.0, 4.0, 1.0, 2.0), (3.0, 0.0, 1.0, 0.0), (5.0, 1.0, 0.0, 1.0), (0.0, 0.0, 1.0, 4.0)]
    df = spark.createDataFrame(data, "pred double, true double, mask double, scale double")
    got = M.aggregate(df, mape=M.masked_mape(), smape=M.masked_smape(), mase=M.masked_mase()).first()
    assert got["mape"] == pytest.approx((2 / 4) / 4)
    assert got["smape"] == pytest.approx(200 * (2 / 6 + 1) / 4)
    assert got["mase"] == pytest.approx((2 / 2) / 4)


def test_seasonal_scale(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.0, 9.0],)], "x array<double>")
    assert df.select(M.seasonal_scale(F.col("x"), 2).alias("s")).first()["s"] == pytest.approx((1 + 5) / 2)


def test_pattern_summary_with_benchmark(spark):
    data = [("Y", 1, 2.0, 4.0, 1.0, 2.0), ("M", 2, 5.0, 4.0, 1.0, 1.0), ("M", 3, 4.0, 4.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "pattern string, series int, pred double, true double, mask double, scale double")
    naive = spark.createDataFrame([("Y", 50.0, 2.0), ("M", 10.0, 1.0)], "pattern string, smape double, mase double")
    got = {r["pattern"]: r for r in M.pattern_summary(df, naive).collect()}
    assert got["Y"]["mase"] == pytest.approx(1.0)
    assert got["M"]["mase"] == pytest.approx(0.5)
    assert got["Average"]["mase"] == pytest.approx((1.0 + 2 * 0.5) / 3)
    assert got["Y"]["owa"] == pytest.approx((200 * 2 / 6 / 50 + 0.5) / 2)


def test_horizons_share_one_rollout(windows):
    got = P.evaluate_horizons(windows, P.forecaster("last_value", 4), [2, 3], 4, ["station", "s_begin"])
    table = {r["horizon"]: (r["rows"], r["mae"]) for r in got.collect()}
    # The last three points of y are 16, 17, 18 above s; the last value of x is 11.
    assert table[2] == (60, pytest.approx((5 + 6) / 2)) and table[3] == (90, pytest.approx(6.0))


def adjust(gt, pred, skip_first):
    out = list(pred)
    i = 0
    while i < len(gt):
        if gt[i]:
            j = i
            while j < len(gt) and gt[j]:
                j += 1
            if any(pred[i:j]):
                for k in range(i, j):
                    if not (skip_first and k == 0):
                        out[k] = 1
            i = j
        else:
            i += 1
    return out


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
@pytest.mark.parametrize("skip_first", [False, True])
def test_point_adjust(spark, block, skip_first):
    rng = np.random.default_rng(block)
    gt = [int(v) for v in np.repeat(rng.integers(0, 2, 30), rng.integers(1, 9, 30))]
    gt[:4] = [1, 1, 1, 1]
    pred = [int(v) for v in rng.random(len(gt)) < 0.15]
    pred[0], pred[2] = 0, 1
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(zip(gt, pred))], "i long, gt int, pred int")
    out = anomaly.point_adjust(df, "i", block_rows=block, skip_first=skip_first).orderBy("i").collect()
    assert [r["adjusted"] for r in out] == adjust(gt, pred, skip_first)


def test_fit_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [([float(v) for v in 1e5 * rng.normal(size=2)], [float(v) for v in rng.normal(size=2)]) for _ in range(5000)]
    df = spark.createDataFrame(rows, "token_in array<double>, token_out array<double>")
    sums = [P.normal_sums(df.repartition(k), 2) for k in (1, 3, 8)]
    assert sums[0] == sums[1] == sums[2]
    whole = [[round(v / P.FIT_STEP) for v in a] + [1] + [round(v / P.FIT_STEP) for v in b] for a, b in rows]
    assert sums[0] == [[sum(r[i] * r[j] for r in whole) for j in range(5)] for i in range(5)]
    assert P.normal_sums(df.limit(0), 2) == [[0] * 5 for _ in range(5)]


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 8])
def test_powers_of_an_affine_map(steps):
    rng = np.random.default_rng(steps)
    w = rng.normal(size=(4, 3)) / 2
    x, want = rng.normal(size=3), []
    token = x
    for _ in range(steps):
        token = token @ w[:-1] + w[-1]
        want.append(token)
    powers = P.affine_powers(w, steps)
    assert x @ powers[:-1] + powers[-1] == pytest.approx(np.concatenate(want))


def test_scaled_linear_rollout_feeds_back(spark):
    w = np.array([[0.5, 0.1], [0.2, 0.7], [0.3, -0.1]])
    df = spark.createDataFrame([([1.0, 4.0, 2.0, 8.0, 5.0],), ([0.0, 0.0, 0.0, 0.0, 1.0],)], "x array<double>")
    got = [r["forecast"] for r in P.rollout(df, P.normalised(P.linear_token(w)), 5, 2).collect()]
    for x, forecast in zip(([1.0, 4.0, 2.0, 8.0, 5.0], [0.0, 0.0, 0.0, 0.0, 1.0]), got, strict=True):
        state, want = np.array(x), []
        for _ in range(3):
            mean, sd = state.mean(), np.sqrt(state.var() + 1e-5)
            token = (((state[-2:] - mean) / sd) @ w[:-1] + w[-1]) * sd + mean
            want += list(token)
            state = np.concatenate([state[2:], token])
        assert forecast == pytest.approx(want[:5])
