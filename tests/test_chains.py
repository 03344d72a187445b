"""Seasonal benchmark, vector sums, mark copies, appends that are repeated, lengths of stored samples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.operators import marks, windows
from gridcast.plans import naive2
from gridcast.queries import marking
from gridcast.sources import sinks


def by_hand(y, season, horizon):
    """The benchmark forecast in plain Python."""
    n = len(y)
    mu = sum(y) / n
    c = [sum((y[i] - mu) * (y[i + k] - mu) for i in range(n - k)) for k in range(season + 1)]
    seasonal = False
    if season > 1 and n >= 3 * season and min(y) > 0 and c[0] > 0:
        r = [v / c[0] for v in c]
        seasonal = abs(r[season]) > 1.645 * math.sqrt((1 + 2 * sum(v * v for v in r[1:season])) / n)
    if not seasonal:
        return False, [y[-1]] * horizon
    half, places = season // 2, [[] for _ in range(season)]
    for centre in range(half, n - half):
        if season % 2:
            average = sum(y[centre - half : centre + half + 1]) / season
        else:
            average = (y[centre - half] / 2 + sum(y[centre - half + 1 : centre + half]) + y[centre + half] / 2) / season
        places[centre % season].append(y[centre] / average)
    means = [sum(p) / len(p) for p in places]
    index = [m / (sum(means) / season) for m in means]
    return True, [y[-1] / index[(n - 1) % season] * index[(n + h) % season] for h in range(horizon)]


@pytest.mark.parametrize(("season", "block"), [(4, None), (3, None), (4, 5), (3, 2), (1, None), (12, 7)])
def test_seasonal_benchmark(spark, season, block, monkeypatch):
    if block:
        monkeypatch.setattr(naive2, "BLOCK_POINTS", block)
    rng = random.Random(season)
    series = {"flat": [5.0] * 20, "one": [3.0], "two": [3.0, 4.0], "negative": [(-1.0) ** i * 5 for i in range(40)]}
    for i in range(6):
        series[f"s{i}"] = [10 + 6 * math.sin(2 * math.pi * t / max(season, 2)) + rng.random() * (1 + 3 * i) for t in range(11 + 14 * i)]
    rows = [(s, t, v, len(y)) for s, y in series.items() for t, v in enumerate(y)]
    points = spark.createDataFrame(rows, "series string, t long, y double, n long").repartition(3)
    got = {(r.series, r.step): r.pred for r in naive2.naive2(points, season, 5).collect()}
    seen = {r.series: r.seasonal for r in naive2.seasonal_profile(points, season).collect()}
    for s, y in series.items():
        seasonal, want = by_hand(y, season, 5)
        assert seen[s] == seasonal and [got[s, h] for h in range(5)] == pytest.approx(want)
    assert any(seen.values()) == (season > 1)
    scales = {r.series: r.scale for r in naive2.seasonal_scales(points, season).collect()}
    for s, y in series.items():
        steps = [abs(b - a) for a, b in zip(y, y[season:], strict=False)]
        assert scales[s] == (pytest.approx(sum(steps) / len(steps)) if steps else None)
    assert naive2.naive2(points.limit(0), season, 5).count() == 0


def test_vector_sums(spark, monkeypatch):
    monkeypatch.setattr(marks, "HELD_KEYS", 2)
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0], 2), ("b", [1.0, None], 1), (None, [7.0], 0), ("b", None, 1), ("c", [5.0], None), ("d", [], 1), ("a", [10.0, 20.0, 30.0], 0)]
    frame = spark.createDataFrame(rows, "k string, vec array<float>, w int").repartition(3)
    got = {r.k: (r.sums, r.weights) for r in marks.vector_sums(frame, ["k"], "vec", "w").collect()}
    assert got == {"a": ([7.0, 2.0, 0.0], 3.0), "b": ([1.0, 0.0], 1.0), None: ([0.0], 0.0), "d": ([], 1.0)}
    (whole,) = marks.vector_sums(frame, [], "vec", "w").collect()
    assert whole.sums == [8.0, 2.0, 0.0] and whole.weights == 5.0
    assert marks.vector_sums(frame.limit(0), ["k"], "vec", "w").collect() == []


def test_mark_statistics(spark):
    rng = np.random.default_rng(2)
    rows = [([[1e6 + float(v) for v in rng.normal(size=3)] for _ in range(2)],) for _ in range(30)] + [([],)]
    (r,) = marks.mark_stats(spark.createDataFrame(rows, "x_mark array<array<double>>")).collect()
    flat = np.array([v for (w,) in rows for m in w for v in m])
    assert (r["mean"], r.low, r.high) == pytest.approx((flat.mean(), flat.min(), flat.max())) and r.sd == pytest.approx(flat.std(ddof=1), rel=1e-3)


def test_blocks_of_marks_are_copied_by_their_windows(spark):
    vectors = spark.range(64).select(F.col("id").alias("t"), F.array(F.col("id").cast("float")).alias("emb"))
    index = spark.range(200).select((F.col("id") % 50).cast("string").alias("station"), (F.col("id") % 40).alias("s_begin")).distinct()
    few, many = (marks.attach_marks(index, vectors, 4, 2, 2, 2, block=16, windows_per_copy=k) for k in (7, 10_000))
    rows = lambda f: sorted((r.station, r.s_begin, r.x_mark, r.y_mark) for r in f.collect())
    assert rows(few) == rows(many)
    assert all(r[2] == [[float(r[1])], [float(r[1] + 2)]] and r[3] == [[float(r[1] + 4)]] for r in rows(few))


def test_appending_a_batch_twice_is_appending_it_once(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "station string, target double"
    rows = lambda *names: spark.createDataFrame([(n, 1.0) for n in names], schema)
    read = lambda: sorted(r.station for r in sinks.read_batches(spark, path, schema).collect())
    assert read() == []
    assert sinks.append_batch(rows("a", "b"), path, "day-1") and not sinks.append_batch(rows("a", "b"), path, "day-1")
    # A batch that was not committed is not seen, and the next attempt replaces it.
    sinks.write_table(rows("lost"), f"{path}/batch=day-2")
    assert read() == ["a", "b"]
    assert sinks.append_batch(rows("c"), path, "day-2") and read() == ["a", "b", "c"]
    with pytest.raises(ValueError, match="name for a batch"):
        sinks.append_batch(rows("x"), path, "../day")


def test_lengths_are_judged_in_one_scan(spark):
    rows = [(1, [1.0, 2.0], [3.0]), (1, [1.0], [3.0]), (None, [1.0, 2.0], None), (2, [5.0, 6.0], [7.0])]
    frame = spark.createDataFrame(rows, "station_id int, x array<double>, y array<double>")
    found = windows.unequal_lengths(frame)
    assert tuple(found.first()) == (4, 1, 1, 1)
    assert tuple(windows.unequal_lengths(frame.limit(0)).first()) == (0, 0, 0, 0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_stored_blocks_join_where_they_lie(spark, data):
    joined = marking.stored_block_windows(spark, data)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert joined.where("x_mark[0] is null").count() == 0 and joined.count() > 0
