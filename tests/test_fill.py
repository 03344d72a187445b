"""Grids and gap filling against pandas, with blocks small enough to cut every gap."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import axis, fill, grid, split

START = dt.datetime(2024, 1, 1)
HOUR = 3600


def readings(spark, series):
    """Long readings; position i of each list is hour i, None is a reading without a value."""
    rows = [
        (START + dt.timedelta(hours=i), name, float(v) if v is not None else None)
        for name, values in series.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "datetime timestamp_ntz, station string, target double")


def by_station(df):
    out = {}
    for r in df.orderBy("station", "t").collect():
        out.setdefault(r["station"], []).append(r["target"])
    return out


def same(a, b):
    return all((x is None) == (y is None or np.isnan(y)) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def ragged_series():
    rng = np.random.default_rng(7)
    series = {}
    for k in range(12):
        values = []
        while len(values) < 60:
            values += [round(float(v), 2) for v in rng.normal(50, 20, rng.integers(1, 4))]
            values += [None] * int(rng.choice([0, 1, 2, 3, 4, 5, 7, 9, 13]))
        values = [None] * int(rng.integers(0, 6)) + values
        series[f"s{k:02d}"] = values[:70] + [None] * (70 - len(values[:70]))
    return series


@pytest.mark.parametrize("block_rows", [1, 4, 7, 4096])
@pytest.mark.parametrize("limit", [1, 2, 3])
def test_fills_match_pandas(spark, ragged_series, block_rows, limit):
    gridded = grid.regular_grid(readings(spark, ragged_series), HOUR, block_rows=block_rows, carry=True)
    limited = by_station(fill.fill_limited(gridded, limit))
    clean = by_station(fill.fill_clean(gridded, limit))
    linear = by_station(fill.fill_linear(gridded))
    for name, values in ragged_series.items():
        s = pd.Series(values, dtype=float, index=pd.date_range(START, periods=len(values), freq="h"))
        lim = s.interpolate(method="time", limit=limit, limit_direction="both")
        assert same(limited[name], lim.to_list()), name
        assert same(clean[name], lim.ffill().bfill().to_list()), name
        flat = s.reset_index(drop=True).interpolate(limit_direction="both").ffill().bfill()
        assert same(linear[name], flat.to_list()), name


def test_long_gap_by_hand(spark):
    values = [None, None, None, 1, None, None, None, None, None, None, 8, None, None, None]
    gridded = grid.regular_grid(readings(spark, {"a": values}), HOUR, block_rows=5, carry=True)
    assert same(by_station(fill.fill_limited(gridded, 2))["a"], [None, 1, 1, 1, 2, 3, None, None, 6, 7, 8, 8, 8, None])
    assert same(by_station(fill.fill_clean(gridded, 2))["a"], [1, 1, 1, 1, 2, 3, 3, 3, 6, 7, 8, 8, 8, 8])


def test_grid_has_every_station_and_step(spark):
    rows = [
        (START, "a", 1.0),
        (START, "a", 3.0),
        (START + dt.timedelta(hours=4), "b", None),
        (START + dt.timedelta(hours=2, minutes=7), "b", 5.0),
    ]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, station string, target double")
    out = grid.flag_missing(grid.regular_grid(df, HOUR, block_rows=2))
    got = {(r["station"], r["t"]): (r["datetime"], r["target"], r["miss_target"]) for r in out.collect()}
    assert len(got) == 10
    assert got["a", 0] == (START, 2.0, 0)
    assert got["b", 4] == (START + dt.timedelta(hours=4), None, 1)
    assert all(got["b", t][1] is None for t in range(5))  # the reading at 02:07 is off the grid


def test_fill_within_splits(spark):
    values = [1.0, None, None, 4.0, None, 6.0, None, None, None, 10.0]
    gridded = grid.regular_grid(readings(spark, {"a": values}), HOUR, block_rows=3, carry=True)
    ranges = split.ratio_ranges(10, 0.5, 0.3)  # [0,5) [5,8) [8,10)
    got = by_station(fill.fill_linear(gridded, ranges=ranges))["a"]
    assert same(got, [1, 2, 3, 4, 4, 6, 6, 6, 10, 10])


def test_exogenous_columns_fill_apart(spark):
    rows = [(START + dt.timedelta(hours=h), "a", float(h), None if h in (1, 2) else 10.0 * h) for h in range(5)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, station string, target double, heat double")
    out = fill.fill_columns(df.where("target <> 3"), axis.time_axis(df), ["target", "heat"]).orderBy("t").collect()
    assert [(r["target"], r["heat"]) for r in out] == [(0, 0), (1, 10), (2, 20), (3, 30), (4, 40)]


def test_empty_table_gives_an_empty_grid(spark):
    df = spark.createDataFrame([], "datetime timestamp_ntz, station string, target double")
    assert grid.regular_grid(df, HOUR, carry=True).count() == 0


def test_axis_grid_follows_the_given_axis(spark):
    hours = [0, 1, 3, 7]
    rows = [(START + dt.timedelta(hours=h), "a", float(h)) for h in hours if h != 3]
    rows += [(START + dt.timedelta(hours=3), "b", 9.0)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, station string, target double")
    ax = axis.time_axis(df)
    assert [r["datetime"].hour for r in ax.orderBy("t").collect()] == hours
    out = by_station(fill.fill_linear(grid.axis_grid(df, ax, block_rows=2, carry=True)))
    assert out == {"a": [0.0, 1.0, 4.0, 7.0], "b": [9.0] * 4}


def test_breaks_and_contiguous_starts(spark):
    hours = [0, 1, 2, 4, 5, 6, 7, 9]
    ax = spark.createDataFrame(
        [(i, START + dt.timedelta(hours=h)) for i, h in enumerate(hours)], "t long, datetime timestamp_ntz"
    )
    flags = [r["is_break"] for r in axis.break_flags(ax, HOUR).orderBy("t").collect()]
    assert flags == [0, 0, 0, 1, 0, 0, 0, 1]
    starts = sorted(r["t"] for r in axis.contiguous_starts(ax, 3, HOUR).collect())
    assert starts == [0, 3, 4]


def test_median_of_even_odd_and_missing(spark):
    rng = np.random.default_rng(3)
    series = {f"s{k}": [round(float(v), 1) for v in rng.normal(0, 30, n)] for k, n in enumerate([1, 2, 9, 40, 41])}
    got = {r["station"]: r["median"] for r in fill.station_medians(readings(spark, series)).collect()}
    assert got == pytest.approx({k: float(np.median(v)) for k, v in series.items()})
    filled = fill.fill_with_median(readings(spark, {"x": [None, None], "y": [1.0, None, 3.0]}))
    assert sorted(r["target"] for r in filled.where("station = 'x'").collect()) == [0.0, 0.0]
    assert sorted(r["target"] for r in filled.where("station = 'y'").collect()) == [1.0, 2.0, 3.0]


def test_median_of_a_narrow_band(spark):
    series = {"x": [1000 + i % 977 / 1e6 for i in range(2000)], "y": [-5.0] * 3 + [-5.0 + i / 1e9 for i in range(500)]}
    got = {r["station"]: r["median"] for r in fill.station_medians(readings(spark, series)).collect()}
    assert got == pytest.approx({k: float(np.median(v)) for k, v in series.items()}, abs=1e-12)


def test_station_ids_of_names_with_a_common_beginning(spark):
    names = [f"Zone {i}" for i in range(500)]
    ids = axis.station_dimension(spark.createDataFrame([(n,) for n in names], "station string"), block_rows=50)
    assert {r["station"]: r["station_id"] for r in ids.collect()} == {n: i for i, n in enumerate(sorted(names))}


def test_positions_and_station_ids(spark):
    names = ["b", "a10", "a2", "zz", "a1"]
    df = spark.createDataFrame([(n,) for n in names * 3], "station string")
    ids = {r["station"]: r["station_id"] for r in axis.station_dimension(df, block_rows=2).collect()}
    assert ids == {n: i for i, n in enumerate(sorted(names))}
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 101).alias("v"))
    out = axis.positions(rows, ["v"], {"_b": F.floor(F.col("v") / 9)}, "p", keys=["k"], total="n").collect()
    for k in range(3):
        mine = sorted((r["v"], r["p"], r["n"]) for r in out if r["k"] == k)
        assert [p for _, p, _ in mine] == list(range(len(mine)))
        assert {n for *_, n in mine} == {len(mine)}


def test_running_total_over_blocks(spark):
    df = spark.range(50).select(F.col("id").alias("t"), (F.col("id") % 4).alias("x"))
    got = [r["c"] for r in axis.running_total(df, "t", "x", "c", block_rows=7).orderBy("t").collect()]
    assert got == list(np.cumsum([i % 4 for i in range(50)]))
