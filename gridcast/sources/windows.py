"""Stored windows and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators.marks import check_marks
from gridcast.operators.windows import unequal_lengths


def read_windows(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """``(station_id, s_begin, x, y)``; ``check`` fails on samples of unequal length."""
    pairs = spark.read.parquet(path)
    if check:
        bad = unequal_lengths(pairs).first()
        if bad["bad_x"] or bad["bad_y"] or bad["bad_station"]:
            raise ValueError(f"unequal samples: {bad.asDict()}")
    return pairs


def read_marks(spark: SparkSession, path: str, axis: DataFrame | None = None) -> DataFrame:
    """``(t, emb)`` or ``(station, t, emb)``, checked against the axis when given."""
    marks = spark.read.parquet(path)
    if "t" not in marks.columns or "emb" not in marks.columns:
        raise ValueError(f"marks need columns t and emb, got {marks.columns}")
    if axis is not None:
        keys = [c for c in ("station",) if c in marks.columns]
        result = check_marks(marks, axis, keys).first()
        if not result["ok"]:
            raise ValueError(f"marks do not match the axis: {result.asDict()}")
    return marks
