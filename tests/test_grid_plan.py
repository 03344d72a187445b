"""Grid rows stay where their block lies."""

import re

import pytest
from pyspark.sql import functions as F

from gridcast.operators import axis, fill, grid


@pytest.fixture
def plain_plans(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def _readings(spark):
    rows = [("a", 0, 1.0), ("a", 3, None), ("a", 4, 5.0), ("a", 4, 7.0), ("a", 9, float("nan")), ("b", 2, 3.0), ("c", 6, None)]
    df = spark.createDataFrame(rows, "station string, h int, target double")
    when = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))
    return df.select(when.alias("datetime"), "station", "target")


def _text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_grid_row_is_shuffled(spark, plain_plans):
    df = fill.fill_linear(grid.regular_grid(_readings(spark), 3600, block_rows=4, carry=True))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\), ?", _text(df))
    # Readings are grouped by station and position; whatever joins or fills the grid lies by station and block.
    wide = [k for k in keys if re.search(r"station#\d+, block#\d+L, t#", k)]
    assert keys and not wide


@pytest.mark.parametrize("block", [1, 3, 4, 10, 64])
def test_every_position_once_with_its_mean(spark, block):
    r = _readings(spark)
    for gridded, steps in ((grid.regular_grid(r, 3600, block_rows=block), 10), (grid.axis_grid(r, axis.time_axis(r), block_rows=block), None)):
        rows = gridded.select("station", "t", "target", "block").collect()
        n = steps or axis.time_axis(r).count()
        assert sorted((x["station"], x["t"]) for x in rows) == [(s, t) for s in "abc" for t in range(n)]
        assert all(x["block"] == x["t"] // block for x in rows)
        if steps:
            got = {(x["station"], x["t"]): x["target"] for x in rows if x["target"] is not None}
            assert got.pop(("a", 9)) != 0
            assert got == {("a", 0): 1.0, ("a", 4): 6.0, ("b", 2): 3.0}
