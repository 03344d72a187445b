"""Grids of a span of positions give the rows that the whole grid has there."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridcast.operators import fill, grid, split, windows

START = dt.datetime(2024, 1, 1)
STEP = 3600


@pytest.fixture(scope="module")
def readings(spark):
    draw = random.Random(5)
    rows = [
        (START + dt.timedelta(hours=draw.randrange(100)), s, None if draw.random() < 0.3 else round(draw.random(), 3))
        for s in ("a", "b", "c")
        for _ in range(40)
    ]
    # Both ends, one reading before any span only, one after only, none at all, and one off the step.
    rows += [(START, "a", 1.0), (START + dt.timedelta(hours=99), "a", 2.0), (START + dt.timedelta(hours=3), "early", 5.0)]
    rows += [(START + dt.timedelta(hours=97), "late", 6.0), (START, "none", None), (START + dt.timedelta(minutes=30), "b", 9.0)]
    return spark.createDataFrame(rows, "datetime timestamp_ntz, station string, target double")


def _rows(df):
    return sorted(map(tuple, df.select("station", "t", "datetime", "target").collect()), key=str)


@pytest.mark.parametrize("span", [(0, 100), (40, 73), (80, 100), (0, 10), (60, 60), (90, 500)])
@pytest.mark.parametrize("block_rows", [7, 4096])
def test_span_of_a_filled_grid(spark, readings, span, block_rows):
    limits = grid.extent_of(readings)
    whole = fill.fill_linear(grid.regular_grid(readings, STEP, limits=limits, carry=True, block_rows=block_rows), default=0.0)
    part = fill.fill_linear(grid.regular_grid(readings, STEP, limits=limits, carry=True, block_rows=block_rows, span=span), default=0.0)
    assert _rows(part) == _rows(whole.where((F.col("t") >= span[0]) & (F.col("t") < span[1])))


def test_windows_of_a_span(spark, readings, monkeypatch):
    limits = grid.extent_of(readings)
    ranges = split.ratio_ranges(limits.steps(STEP)).only("test")
    assert ranges.span() == (80, 100)
    whole = windows.windows(fill.fill_linear(grid.regular_grid(readings, STEP, limits=limits, carry=True)), 6, 3, 2, ranges)
    filled = fill.fill_linear(grid.regular_grid(readings, STEP, limits=limits, carry=True, span=ranges.span()))
    cut = windows.windows(filled, 6, 3, 2, ranges, first=80)
    want = sorted(map(str, whole.collect()))
    assert len(want) == 6 * 13 and sorted(map(str, cut.collect())) == want
    # Small blocks: windows reach from one into the next.
    small = windows.windows(filled.drop("block"), 6, 3, 2, ranges, block_points=4, first=80)
    assert sorted(map(str, small.collect())) == want


def test_series_of_one_block_send_no_heads(spark, readings):
    """The heads of blocks made every grid row a second time."""
    limits = grid.extent_of(readings)
    filled = fill.fill_linear(grid.regular_grid(readings, STEP, limits=limits, carry=True))
    cut = windows.windows(filled, 6, 3, 2, split.ratio_ranges(100).only("test"))
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
