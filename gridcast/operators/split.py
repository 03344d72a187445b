"""Chronological splits as position ranges ``[start, end)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.numbers import whole_share
from gridcast.operators.axis import positions

SPLITS = ("train", "val", "test")
TRAIN_RATIO, VAL_RATIO, TEST_RATIO = 0.7, 0.1, 0.2
# Calendar split of hourly tables, 12 + 4 + 4 months of 30 days.
MONTH_HOURS = 30 * 24
CALENDAR_MONTHS = (12, 4, 4)


Position = int | Column


def _column(value: Position) -> Column:
    return value.cast("long") if isinstance(value, Column) else F.lit(value).cast("long")


def _share(length: Position, ratio: float) -> Position:
    """``int(length * ratio)``: truncated double product, so 720 * 0.7 gives 503."""
    return whole_share(length, ratio) if isinstance(length, Column) else int(length * ratio)


def _floor_zero(value: Position) -> Position:
    return F.greatest(value, F.lit(0).cast("long")) if isinstance(value, Column) else max(value, 0)


@dataclass(frozen=True)
class Ranges:
    """Start and end position of each split: numbers for one axis, columns per series."""

    bounds: dict[str, tuple[Position, Position]]

    def array(self) -> Column:
        return F.array(
            *[
                F.struct(F.lit(name).alias("split"), _column(lo).alias("start"), _column(hi).alias("end"))
                for name, (lo, hi) in self.bounds.items()
            ]
        )

    def end(self, split: str) -> Position:
        return self.bounds[split][1]

    def span(self) -> tuple[int, int]:
        """First position of any split and the one after the last, where all are numbers."""
        return min(lo for lo, _ in self.bounds.values()), max(hi for _, hi in self.bounds.values())

    def only(self, *splits: str) -> Ranges:
        return Ranges({s: self.bounds[s] for s in splits})


def ratio_ranges(length: Position, train: float = TRAIN_RATIO, val: float = VAL_RATIO) -> Ranges:
    """Disjoint splits; windows must lie inside one split."""
    n_train, n_val = _share(length, train), _share(length, val)
    return Ranges(
        {"train": (0, n_train), "val": (n_train, n_train + n_val), "test": (n_train + n_val, length)}
    )


def lookback_ranges(length: Position, seq_len: int, val_is_rest: bool = True) -> Ranges:
    """Validation and test reach back by one lookback.

    ``val_is_rest`` gives validation whatever train and test leave over;
    otherwise it takes its own 10 % share.
    """
    n_train, n_test = _share(length, TRAIN_RATIO), _share(length, TEST_RATIO)
    n_val = length - n_train - n_test if val_is_rest else _share(length, VAL_RATIO)
    return Ranges(
        {
            "train": (0, n_train),
            "val": (n_train - seq_len, n_train + n_val),
            "test": (length - n_test - seq_len, length),
        }
    )


def calendar_ranges(seq_len: int, unit: int = MONTH_HOURS, months: tuple[int, int, int] = CALENDAR_MONTHS) -> Ranges:
    a, b, c = (m * unit for m in months)
    return Ranges(
        {
            "train": (0, a),
            "val": (a - seq_len, a + b),
            "test": (a + b - seq_len, a + b + c),
        }
    )


def per_series_ranges(length: Position, seq_len: int, pred_len: int) -> Ranges:
    """Each series keeps its last horizon for test and the one before for validation."""
    train_len = length - pred_len
    return Ranges(
        {
            "train": (0, train_len - pred_len),
            "val": (_floor_zero(train_len - seq_len - pred_len), train_len),
            "test": (_floor_zero(train_len - seq_len), length),
        }
    )


def label_split(df: DataFrame, ranges: Ranges, t: str = "t") -> DataFrame:
    """``split`` name of each position, for disjoint ranges."""
    name = F.lit(None).cast("string")
    for split, (lo, hi) in ranges.bounds.items():
        name = F.when((F.col(t) >= _column(lo)) & (F.col(t) < _column(hi)), F.lit(split)).otherwise(name)
    return df.withColumn("split", name)


def explode_splits(df: DataFrame, ranges: Ranges, t: str = "t") -> DataFrame:
    """One row per split that covers the position, for overlapping ranges."""
    covering = F.filter(ranges.array(), lambda r: (r["start"] <= F.col(t)) & (F.col(t) < r["end"]))
    return df.select("*", F.explode(F.transform(covering, lambda r: r["split"])).alias("split"))


# Starts that are ranked together.
RANK_BLOCK = 8192


def sample_order_split(
    samples: DataFrame, station: str = "station_id", begin: str = "s_begin", train: float = TRAIN_RATIO, val: float = VAL_RATIO
) -> DataFrame:
    """First 70 % of the stored samples train, next 10 % validate, the rest test.

    Stored order is by station, then start, so this splits by station rather
    than by time.  The rank comes from one count per block of starts and the place
    within it, so starts may have gaps; neither samples nor blocks are sorted in one task.
    """
    block = {"_station": F.col(station), "_part": F.floor(F.col(begin) / RANK_BLOCK)}
    ranked = positions(samples, [begin], block, "sample_id", total="_total")
    return label_split(ranked, ratio_ranges(F.col("_total"), train, val), "sample_id").drop("_total")
