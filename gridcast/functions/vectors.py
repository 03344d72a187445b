"""Array expressions: slices, tokens, norms, mixing. One row in, one row out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridcast.functions.columns import as_col

# Fixed value: variance guard of the per-window normalisation.
WINDOW_VAR_EPS = 1e-5


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(values).cast("double"))


def array_var(values: Column, mean: Column) -> Column:
    """Population variance around a mean that is already a column."""
    sq = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.try_divide(sq, F.size(values).cast("double"))


def head(values: Column, n: int | Column) -> Column:
    return F.slice(values, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def tail(values: Column, n: int) -> Column:
    """Last ``n`` items, or all of a shorter array."""
    size = F.size(values)
    return F.slice(values, F.greatest(size - n, F.lit(0)) + 1, F.lit(n))


def pad_left(values: Column, length: int, fill: float = 0.0) -> Column:
    gap = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.concat(F.array_repeat(F.lit(float(fill)), gap), values)


def pad_right(values: Column, length: int, fill: float = 0.0) -> Column:
    gap = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(F.lit(float(fill)), gap))


def tokens(values: Column, token_len: int, count: int | None = None) -> Column:
    """Consecutive tokens from the oldest point; an incomplete newest token is left out."""
    n = F.lit(count) if count is not None else F.floor(F.size(values) / token_len).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(values, (i - 1) * token_len + 1, F.lit(token_len)))
    return F.when(n > 0, cut)


def untokenise(token_list: Column) -> Column:
    return F.flatten(token_list)


def l2_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def scale_by(values: Column, divisor: Column) -> Column:
    return F.transform(values, lambda v: F.try_divide(v.cast("double"), divisor))


def unit(values: Column) -> Column:
    return scale_by(values, l2_norm(values))


def mix(base: Column, mark: Column, scale: float | Column) -> Column:
    """Unit-length base plus ``scale`` times the unit-length mark."""
    weight = scale if isinstance(scale, Column) else F.lit(float(scale))
    base_norm, mark_norm = l2_norm(base), l2_norm(mark)
    return F.zip_with(
        base,
        mark,
        lambda b, m: F.try_divide(b.cast("double"), base_norm) + weight * F.try_divide(m.cast("double"), mark_norm),
    )


def zeros(n: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), n if isinstance(n, Column) else F.lit(n))


def zero_marks(count: int, dim: int) -> Column:
    """``count`` zero vectors of length ``dim``."""
    return F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), dim), count)


def instance_norm(values: Column | str) -> dict[str, Column]:
    """Mean, guarded deviation and normalised values of one lookback window."""
    values = as_col(values)
    mean = array_mean(values)
    sd = F.sqrt(array_var(values, mean) + F.lit(WINDOW_VAR_EPS))
    return {"mean": mean, "sd": sd}


def normalise(values: Column, mean: Column, sd: Column) -> Column:
    return F.transform(values, lambda v: (v - mean) / sd)


def denormalise(values: Column, mean: Column, sd: Column) -> Column:
    return F.transform(values, lambda v: v * sd + mean)


def drop_nulls(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))


def fixed_point(values: Column, digits: int = 4) -> Column:
    """Comma-joined rounded integers of a numeric array: an engine-neutral rendering."""
    return F.array_join(
        F.transform(values, lambda v: F.round(v.cast("double") * 10**digits, 0).cast("long").cast("string")),
        ",",
        "null",
    )
