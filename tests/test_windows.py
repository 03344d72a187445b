"""Windows, splits, ragged series and marks against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.functions import vectors as V
from gridcast.operators import marks, ragged, split, windows


def table(spark, n, stations=("a", "b")):
    rows = [(s, t, float(1000 * k + t)) for k, s in enumerate(stations) for t in range(n)]
    return spark.createDataFrame(rows, "station string, t long, target double")


@pytest.mark.parametrize("block", [1, 3, 8, 2048])
def test_windows_for_any_block_size(spark, block):
    n, seq, label, pred = 40, 6, 4, 3
    ranges = split.ratio_ranges(n)
    out = windows.windows(table(spark, n), seq, label, pred, ranges, block_points=block).collect()
    bounds = {"train": (0, 28), "val": (28, 32), "test": (32, 40)}
    expected = {
        (s, name, b)
        for s in ("a", "b")
        for name, (lo, hi) in bounds.items()
        for b in range(lo, hi - (seq + pred) + 1)
    }
    assert {(r["station"], r["split"], r["s_begin"]) for r in out} == expected
    assert len(out) == len(expected)
    for r in out:
        base = 0 if r["station"] == "a" else 1000
        assert r["x"] == [float(base + r["s_begin"] + i) for i in range(seq)]
        assert r["y"] == [float(base + r["s_begin"] + seq - label + i) for i in range(label + pred)]


def test_index_agrees_with_windows(spark):
    n = 50
    ranges = split.lookback_ranges(n, 6)
    series = spark.createDataFrame([("a", n), ("b", n)], "station string, n long")
    index = windows.windows_index(series, 9, ranges, block_points=4)
    cut = windows.windows(table(spark, n), 6, 4, 3, ranges, block_points=4)
    key = ["station", "split", "s_begin"]
    assert sorted(index.select(key).collect()) == sorted(cut.select(key).collect())


def test_ratio_bounds_truncate():
    assert split.ratio_ranges(720).bounds == {"train": (0, 503), "val": (503, 575), "test": (575, 720)}
    assert split.lookback_ranges(100, 10).bounds["val"] == (60, 80)
    assert split.lookback_ranges(15, 2, val_is_rest=False).bounds["val"] == (8, 11)
    assert split.calendar_ranges(96).bounds["test"] == (11520 - 96, 14400)


def test_last_window_switch(spark):
    whole = windows.precut_pairs(table(spark, 12), 4, 2, 12)
    short = windows.precut_pairs(table(spark, 12), 4, 2, 12, include_last=False)
    assert whole.where("station = 'a'").count() == 7
    assert short.where("station = 'a'").count() == 6
    none = windows.precut_pairs(table(spark, 6), 4, 2, 6, include_last=False)
    assert none.count() == 0


def test_sample_order_split(spark):
    samples = spark.createDataFrame([(s, b) for s in range(3) for b in range(5, 12)], "station_id int, s_begin long")
    out = windows_split = split.sample_order_split(samples).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in windows_split] == list(range(21))
    assert [r["split"] for r in out] == ["train"] * 14 + ["val"] * 2 + ["test"] * 5


def test_shuffle_is_a_seeded_permutation(spark):
    samples = spark.range(103).withColumnRenamed("id", "sample")
    first = windows.shuffled_batches(samples, 5, 10, ["sample"], drop_last=False).collect()
    again = windows.shuffled_batches(samples, 5, 10, ["sample"], drop_last=False).collect()
    other = windows.shuffled_batches(samples, 6, 10, ["sample"], drop_last=False).collect()
    order = lambda rows: [r["sample"] for r in sorted(rows, key=lambda r: r["position"])]
    assert sorted(r["position"] for r in first) == list(range(103))
    assert order(first) == order(again) != order(other)
    full = windows.shuffled_batches(samples, 5, 10, ["sample"])
    assert full.count() == 100 and full.groupBy("batch").count().where("count != 10").count() == 0


def test_tokens_and_back(spark):
    df = spark.createDataFrame([([float(i) for i in range(7)],)], "x array<double>")
    row = df.select(V.tokens(F.col("x"), 3).alias("k"), V.untokenise(V.tokens(F.col("x"), 3)).alias("b")).first()
    assert row["k"] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    assert row["b"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_norm_round_trip(spark):
    x = [3.0, 5.0, 5.0, 11.0]
    stats = V.instance_norm("x")
    df = spark.createDataFrame([(x,)], "x array<double>").withColumn("m", stats["mean"]).withColumn("s", stats["sd"])
    normed = V.normalise(F.col("x"), F.col("m"), F.col("s"))
    row = df.select(normed.alias("z"), V.denormalise(normed, F.col("m"), F.col("s")).alias("b")).first()
    assert row["z"] == pytest.approx((np.array(x) - 6) / np.sqrt(np.var(x) + 1e-5))
    assert row["b"] == pytest.approx(x)


SERIES = {1: [5.0], 2: [float(i) for i in range(9)], 3: [float(i * i) for i in range(20)], 4: [1.0, 2.0, 3.0, 4.0]}


@pytest.fixture
def points(spark):
    rows = [(k, i, v) for k, vs in SERIES.items() for i, v in enumerate(vs)] + [(3, 100, None), (3, 101, float("nan"))]
    long = spark.createDataFrame(rows, "series long, at long, y double")
    return ragged.with_positions(long, ["at"], {"_b": F.floor(F.col("at") / 3)})


def test_positions_close_gaps(points):
    got = {}
    for r in points.orderBy("series", "t").collect():
        got.setdefault(r["series"], []).append((r["t"], r["y"], r["n"]))
    assert got == {k: [(i, v, len(vs)) for i, v in enumerate(vs)] for k, vs in SERIES.items()}


def test_last_and_prompt_windows(points):
    last = {r["series"]: (r["x"], r["mask"]) for r in ragged.last_window(points, 6).collect()}
    for k, vs in SERIES.items():
        pad = [0.0] * max(0, 6 - len(vs))
        assert last[k] == (pad + vs[-6:], pad + [1.0] * min(6, len(vs)))
    prompt = {r["series"]: (r["x"], r["y"]) for r in ragged.prompt_window(points, 2).collect()}
    assert set(prompt) == {2, 3}
    for k, (x, y) in prompt.items():
        vs = SERIES[k]
        assert x == vs[:4] + vs[-4:-2] and y == vs[-2:]


def test_per_series_splits(points):
    seq, label, pred = 6, 3, 3
    rows = ragged.series_windows(points, seq, label, pred).collect()
    for k, vs in SERIES.items():
        full = [0.0] * max(0, seq + pred - len(vs)) + vs
        n = len(full)
        borders = {
            "train": (0, n - 2 * pred),
            "val": (max(n - 2 * pred - seq, 0), n - pred),
            "test": (n - pred - seq, n),
        }
        want = sorted(
            (name, b, full[b : b + seq], full[b + seq - label : b + seq + pred])
            for name, (lo, hi) in borders.items()
            for b in range(lo, hi - seq - pred + 1)
        )
        got = sorted((r["split"], r["s_begin"], r["x"], r["y"]) for r in rows if r["series"] == k)
        assert got == want
        assert sum(g[0] == "test" for g in got) == 1


def test_random_cut_windows(points):
    seq, label, pred, limit = 6, 3, 3, 5
    rows = ragged.random_cut_windows(points, seq, label, pred, limit, seed=1).collect()
    assert {r["series"] for r in rows} == set(SERIES)
    for r in rows:
        vs, c = SERIES[r["series"]], r["cut"]
        assert max(1, len(vs) - limit) <= c and (c < len(vs) or len(vs) == 1)
        ins = vs[max(0, c - seq) : c]
        outs = vs[max(0, c - label) : c + pred]
        assert r["insample"] == [0.0] * (seq - len(ins)) + ins
        assert r["insample_mask"] == [0.0] * (seq - len(ins)) + [1.0] * len(ins)
        assert r["outsample"] == outs + [0.0] * (label + pred - len(outs))
        assert r["outsample_mask"] == [1.0] * len(outs) + [0.0] * (label + pred - len(outs))


@pytest.mark.parametrize("block,copies", [(2, 1), (5, 3), (256, 8)])
def test_marks_at_token_positions(spark, block, copies):
    table = spark.createDataFrame([(t, [float(t), -float(t)]) for t in range(40)], "t long, emb array<float>")
    index = spark.createDataFrame([("a", s) for s in range(0, 28)], "station string, s_begin long")
    out = marks.attach_marks(index, table, 8, 4, 4, 4, block=block, copies=copies).collect()
    assert len(out) == 28
    for r in out:
        s = r["s_begin"]
        assert [v[0] for v in r["x_mark"]] == [s, s + 4]
        assert [v[0] for v in r["y_mark"]] == [s + 8]


def test_mark_check_sees_gaps(spark):
    ax = spark.range(5).withColumnRenamed("id", "t")
    good = spark.createDataFrame([(t, [1.0]) for t in range(5)], "t long, emb array<float>")
    assert marks.check_marks(good, ax).first()["ok"]
    assert not marks.check_marks(good.where("t < 4"), ax).first()["ok"]
    assert not marks.check_marks(good.withColumn("t", F.col("t") + 1), ax).first()["ok"]
