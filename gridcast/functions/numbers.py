"""Numeric expressions that treat missing and non-finite values explicitly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridcast.functions.columns import as_col

INFINITY = float("inf")
# Smallest scale accepted by the two scalers.
SCALE_FLOOR = 1e-6
FULL_SERIES_EPS = 1e-6

# Text tokens that mean "no reading".
MISSING_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "n/a", "-nan", "<NA>")


def parse_number(text: Column | str) -> Column:
    """Lenient number: NULL for anything that is not a number, NaN included."""
    value = F.trim(as_col(text)).try_cast("double")
    return F.when(~F.isnan(value), value)


def nan_to_null(value: Column | str) -> Column:
    value = as_col(value)
    return F.when(~F.isnan(value), value)


def is_finite(value: Column | str) -> Column:
    value = as_col(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(INFINITY))


def divide_or_zero(num: Column, den: Column) -> Column:
    """``num/den`` with 0 for 0/0 and for +infinity; -infinity is kept."""
    at_zero = F.when(num < 0, F.lit(-INFINITY)).otherwise(F.lit(0.0))
    return F.when(den == 0, at_zero).otherwise(F.try_divide(num, den))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """Share of a count; 0 when there is nothing to count."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def clamp_min(value: Column, floor: float) -> Column:
    return F.greatest(value, F.lit(floor))


def round_scaled(value: Column, digits: int) -> Column:
    """Rounding of a double the way SQL does it: scaled up, taken to the nearest whole number, scaled down.

    ``F.round`` goes by the decimal digits of the value instead, which tells apart doubles next to a half that are
    one after scaling (58.473749999999995 gives 58.4738 here, 58.4737 there).
    """
    scale = 10.0**digits
    return F.round(value * scale, 0) / scale


def standardise(value: Column, mean: Column, sd: Column) -> Column:
    return (value - mean) / sd


def unstandardise(value: Column, mean: Column, sd: Column) -> Column:
    return value * sd + mean


def whole_share(count: Column, ratio: float) -> Column:
    """``int(count * ratio)`` in double arithmetic, truncated (720 * 0.7 gives 503)."""
    return F.floor(count.cast("double") * F.lit(float(ratio))).cast("long")
