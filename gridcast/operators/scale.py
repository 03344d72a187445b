"""Mean and deviation per station or channel, and their use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.numbers import FULL_SERIES_EPS, SCALE_FLOOR, clamp_min, standardise, unstandardise
from gridcast.staging import small_side


def train_scale(df: DataFrame, train_end: int | Column, keys: Sequence[str] = ("station",), value: str = "target") -> DataFrame:
    """``mu`` and ``sd`` over the training positions; population deviation, floored."""
    train = df.where(F.col("t") < train_end)
    return train.groupBy(*keys).agg(
        F.avg(value).alias("mu"), clamp_min(F.stddev_pop(value), SCALE_FLOOR).alias("sd")
    )


def full_scale(df: DataFrame, keys: Sequence[str] = ("station",), value: str = "target") -> DataFrame:
    """``mu`` and ``sd`` over all positions.  Later values leak into earlier windows."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mu"), (F.stddev_pop(value) + F.lit(FULL_SERIES_EPS)).alias("sd")
    )


def channel_scale(df: DataFrame, train_end: int | Column, value: str = "value") -> DataFrame:
    """Library-style scaler: a constant channel is divided by 1."""
    train = df.where(F.col("t") < train_end)
    sd = F.stddev_pop(value)
    return train.groupBy("channel").agg(F.avg(value).alias("mu"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))


def apply_scale(df: DataFrame, params: DataFrame, keys: Sequence[str] = ("station",), value: str = "target") -> DataFrame:
    """One row of ``params`` per key; the columns ``mu`` and ``sd`` stay for the way back."""
    joined = df.join(small_side(params), list(keys))
    return joined.withColumn(value, standardise(F.col(value), F.col("mu"), F.col("sd")))


def undo_scale(df: DataFrame, value: str = "target") -> DataFrame:
    return df.withColumn(value, unstandardise(F.col(value), F.col("mu"), F.col("sd")))
