"""Prefix scans in two levels, the keyed permutation, blocks with points from behind."""

import random

import pytest
from pyspark.sql import functions as F

from gridcast.functions.permute import Permutation
from gridcast.operators import axis, grid, split, windows


def test_starts_of_blocks_by_runs(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice("abcdef") if rng.random() > 0.1 else None, rng.randrange(60)) for _ in range(150)}, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    rows = [(s, p, rng.randrange(9)) for s, p in rows]
    frame = spark.createDataFrame(rows, "s string, p long, n long").repartition(3)
    for run_blocks in (7, 4096):
        got = {(r.s, r.p): r.at for r in axis.starts_before(frame, ["s", "p"], "n", "at", run_blocks).collect()}
        total, want = 0, {}
        for s, p, n in rows:
            want[s, p] = total
            total += n
        assert got == want
    assert axis.starts_before(frame.limit(0), ["s", "p"], "n").collect() == []


def unpartitioned(frame):
    """Windows of the plan that order all rows in one task."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Window [")]
    return [line for line in lines if "], [" not in line]


def test_ranks_have_no_single_task(spark):
    samples = spark.range(500).select((F.col("id") % 7).cast("string").alias("station_id"), F.col("id").alias("s_begin"))
    ranked = split.sample_order_split(samples)
    assert unpartitioned(ranked) == []
    got = [(r.station_id, r.s_begin, r.sample_id) for r in ranked.orderBy("sample_id").collect()]
    assert [g[2] for g in got] == list(range(500)) and [g[:2] for g in got] == sorted(g[:2] for g in got)
    assert unpartitioned(axis.running_total(spark.range(9).selectExpr("id as t", "id as v"), "t", "v", "w")) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4096])
def test_permutation(spark, n):
    perm = Permutation(n, seed=7)
    want = [perm.of(x) for x in range(n)]
    assert sorted(want) == list(range(n))
    got = {r.id: r.to for r in spark.range(n).select("id", perm.column(F.col("id")).alias("to")).collect()}
    assert got == dict(enumerate(want))
    if n == 1000:
        assert want != [Permutation(n, seed=8).of(x) for x in range(n)]
        # Neither order nor neighbourhood is kept.
        assert abs(sum((a - 499.5) * (b - 499.5) for a, b in enumerate(want))) < 0.15 * sum((a - 499.5) ** 2 for a in range(n))


def test_shuffled_batches_of_nothing(spark):
    none = spark.createDataFrame([], "station string, s_begin long")
    assert windows.shuffled_batches(none, 1, 4, ["station", "s_begin"]).count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(8, 0), (8, 3), (8, 8), (8, 21), (50, 7)])
def test_blocks_reach_into_those_behind(spark, size, overlap):
    rows = [(s, t, float(t) if t % 5 else None) for s, n in (("a", 40), ("b", 17), (None, 9)) for t in range(n)]
    frame = spark.createDataFrame(rows, "station string, t long, target double").repartition(4)
    got = {(r.station, r.part): (r.base, r.points) for r in windows.series_blocks(frame, overlap, block_points=size).collect()}
    values = {s: [y for k, _, y in rows if k == s] for s in ("a", "b", None)}
    want = {(s, p): (p * size, v[p * size : p * size + size + overlap]) for s, v in values.items() for p in range(-(-len(v) // size))}
    assert got == want


def test_gaps_and_ends_fail(spark):
    def frame(ts):
        return spark.createDataFrame([("a", t, 1.0) for t in ts], "station string, t long, target double")

    whole = split.Ranges({"all": (0, 30)})
    for ts in ([*range(8), *range(16, 30)], [*range(12), *range(13, 30)], list(range(25))):
        for size in (8, 4):
            with pytest.raises(Exception, match="gaps or repeats"):
                windows.windows(frame(ts), 3, 0, 2, whole, block_points=size).collect()


def test_points_of_a_grid_are_not_sent_again(spark):
    readings = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-02 00:00:00", 2.0)], "station string, d string, target double")
    readings = readings.select("station", F.col("d").cast("timestamp_ntz").alias("datetime"), "target")
    table = grid.regular_grid(readings, 3600)
    cut = windows.windows(table, 4, 0, 2, split.Ranges({"all": (0, 25)}))
    assert cut.count() == 40
    plan = cut._jdf.queryExecution().executedPlan().toString()
    # The exchange above the collected arrays carries the heads alone.
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line]
    by_points = windows.windows(table.drop("block"), 4, 0, 2, split.Ranges({"all": (0, 25)}))
    more = [line for line in by_points._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line]
    assert len(more) > len(exchanges)
