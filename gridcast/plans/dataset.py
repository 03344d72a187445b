"""From long readings of many stations to training windows with marks, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators import axis, fill, grid, marks, scale, split, windows
from gridcast.staging import settle


def multistation_windows(
    readings: DataFrame,
    time_marks: DataFrame,
    station_marks: DataFrame | None,
    seq_len: int,
    label_len: int,
    pred_len: int,
    token_len: int,
    step_seconds: int,
    time_axis: DataFrame | None = None,
) -> DataFrame:
    """``(station, split, s_begin, x, y, x_mark, y_mark)`` of all stations on their common axis.

    Gaps of a station are filled by position, what is left of a station without any value with 0; values are
    scaled by each station's training share; windows lie in one split and cross no break of the axis.  Marks
    are those of the axis, with the station's own appended where there are any.
    """
    ax = settle(axis.time_axis(readings)) if time_axis is None else time_axis
    n = grid.axis_length(ax)
    ranges = split.ratio_ranges(n)
    table = fill.fill_linear(grid.axis_grid(readings, ax, n_steps=n, carry=True), default=0.0)
    scaled = scale.apply_scale(table, scale.train_scale(table, ranges.end("train"))).drop("mu", "sd")
    cut = windows.windows(scaled, seq_len, label_len, pred_len, ranges)
    whole = windows.keep_contiguous(cut, axis.contiguous_starts(ax, seq_len + pred_len, step_seconds))
    marked = marks.attach_marks(whole, time_marks, seq_len, label_len, pred_len, token_len)
    if station_marks is None:
        return marked
    names = ("_own_x", "_own_y")
    both = marks.attach_marks(marked, station_marks, seq_len, label_len, pred_len, token_len, ["station"], names=names)
    joined = {c: marks.join_marks(F.col(c), F.col(own)) for c, own in zip(("x_mark", "y_mark"), names, strict=True)}
    return both.withColumns(joined).drop(*names)
