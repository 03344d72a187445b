"""Collections of series of different lengths, in long form ``(series, t, y, n)``.

``n`` is the length of the series.  Only the few points a window needs are ever
gathered; a long series is never turned into one array, and no step joins on the
series key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions import vectors as V
from gridcast.functions.draws import draw
from gridcast.operators.axis import positions
from gridcast.operators.split import per_series_ranges
from gridcast.operators.windows import windows

KEY = "series"
COLUMNS = (KEY, "t", "y", "n")


def with_positions(long: DataFrame, order: Sequence[str], block: dict[str, Column]) -> DataFrame:
    """Position and series length of each value that is present; missing values close up."""
    present = long.where(F.col("y").isNotNull() & ~F.isnan("y"))
    return positions(present, order, block, "t", keys=[KEY], total="n").select(*COLUMNS)


def lengths(points: DataFrame) -> DataFrame:
    return points.where(F.col("t") == 0).select(KEY, "n")


def drop_short(points: DataFrame, token_len: int) -> DataFrame:
    """Series of more than four tokens."""
    return points.where(F.col("n") > 4 * token_len)


def pad_front(points: DataFrame, minimum: int) -> DataFrame:
    """Zeros in front of series shorter than ``minimum``; positions move up."""
    gap = F.greatest(F.lit(minimum) - F.col("n"), F.lit(0))
    length = F.greatest(F.col("n"), F.lit(minimum).cast("long")).alias("n")
    moved = points.select(KEY, (F.col("t") + gap).alias("t"), "y", length)
    short = lengths(points).where(F.col("n") < minimum)
    slots = F.explode(F.sequence(F.lit(0).cast("long"), minimum - 1 - F.col("n"))).alias("t")
    filler = short.select(KEY, slots, F.lit(0.0).alias("y"), F.lit(minimum).cast("long").alias("n"))
    return moved.unionByName(filler)


def series_windows(points: DataFrame, seq_len: int, label_len: int, pred_len: int) -> DataFrame:
    """Per-series splits after front padding: at most one validation and exactly one test window."""
    padded = pad_front(points, seq_len + pred_len)
    ranges = per_series_ranges(F.col("n"), seq_len, pred_len)
    return windows(padded, seq_len, label_len, pred_len, ranges, keys=[KEY], value="y", carry=["n"])


def _gather(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Bounded gather: callers have already cut each series to a fixed number of rows."""
    return rows.groupBy(KEY, *extra).agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("p"))


def _values(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["y"])


def _ones(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(1.0))


def last_window(points: DataFrame, seq_len: int) -> DataFrame:
    """``(series, x, mask)``: last ``seq_len`` points, zeros in front of shorter series."""
    recent = points.where(F.col("t") >= F.col("n") - seq_len)
    w = _values(F.col("p"))
    return _gather(recent).select(
        KEY, V.pad_left(w, seq_len).alias("x"), V.pad_left(_ones(w), seq_len).alias("mask")
    )


def prompt_window(points: DataFrame, token_len: int) -> DataFrame:
    """``(series, x, y)``: first two tokens and the second-to-last one, then the last token."""
    edge = 2 * token_len
    ends = drop_short(points, token_len).where((F.col("t") < edge) | (F.col("t") >= F.col("n") - edge))
    w = _values(F.col("p"))
    return _gather(ends).select(
        KEY,
        F.slice(w, F.lit(1), F.lit(3 * token_len)).alias("x"),
        F.slice(w, F.lit(3 * token_len + 1), F.lit(token_len)).alias("y"),
    )


def random_cut_windows(
    points: DataFrame, seq_len: int, label_len: int, pred_len: int, limit: int, seed: int
) -> DataFrame:
    """One seeded random cut per series with right- and left-aligned windows and masks.

    The cut lies in ``[max(1, n - limit), n)``; a label that reaches before the
    series starts at its first point.
    """
    low = F.greatest(F.lit(1).cast("long"), F.col("n") - limit)
    span = F.greatest(F.col("n") - low, F.lit(1).cast("long"))
    placed = points.withColumn("cut", low + F.pmod(draw(seed, F.col(KEY)), span))
    back = max(seq_len, label_len)
    near = placed.where((F.col("t") >= F.col("cut") - back) & (F.col("t") < F.col("cut") + pred_len))
    c, p = F.col("cut"), F.col("p")
    inside = _values(F.filter(p, lambda q: (q["t"] >= c - seq_len) & (q["t"] < c)))
    first = F.greatest(c - label_len, F.lit(0).cast("long"))
    outside = _values(F.filter(p, lambda q: (q["t"] >= first) & (q["t"] < c + pred_len)))
    out = label_len + pred_len
    return _gather(near, ["n", "cut"]).select(
        KEY,
        "n",
        "cut",
        V.pad_left(inside, seq_len).alias("insample"),
        V.pad_left(_ones(inside), seq_len).alias("insample_mask"),
        V.pad_right(outside, out).alias("outsample"),
        V.pad_right(_ones(outside), out).alias("outsample_mask"),
    )
