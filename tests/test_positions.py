import pytest

from gridcast.operators.marks import check_marks
from gridcast.operators.split import sample_order_split
from gridcast.operators.windows import series_blocks


def test_a_gap_fails_and_does_not_shift(spark):
    gap = spark.createDataFrame([("a", t, float(t)) for t in (0, 1, 2, 4, 5)], "station string, t long, target double")
    with pytest.raises(Exception, match="gaps or repeats"):
        series_blocks(gap, 3).collect()


def test_sample_order_with_gaps(spark):
    rows = [(0, 0), (0, 5), (0, 9), (1, 0)]
    got = sample_order_split(spark.createDataFrame(rows, "station_id int, s_begin long"))
    assert sorted((r.station_id, r.s_begin, r.sample_id) for r in got.collect()) == [(0, 0, 0), (0, 5, 1), (0, 9, 2), (1, 0, 3)]


def test_a_station_without_marks_is_reported(spark):
    axis = spark.createDataFrame([(0,), (1,)], "t long")
    marks = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0])], "station string, t long, emb array<double>")
    stations = spark.createDataFrame([("a",), ("b",)], "station string")
    assert check_marks(marks, axis, ["station"], stations).first()["ok"] is False
