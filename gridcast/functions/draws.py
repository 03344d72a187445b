"""Random numbers by counter: a digest of seed, key and number of the draw, the same in any engine and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hexadecimal digits of the digest that make up a draw: 60 bits, which a signed 64-bit integer holds.
DIGITS = 15


def draw(seed: int, key: Column, number: int = 0) -> Column:
    """An integer from 0 up to 2^60; a null key draws like an empty text."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.lit(str(number)))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def draw_sql(seed: int, key: str, number: int = 0) -> str:
    """The same in SQL."""
    text = f"'{seed}:' || coalesce(CAST({key} AS VARCHAR), '') || ':{number}'"
    return f"CAST('0x' || substr(md5({text}), 1, {DIGITS}) AS BIGINT)"
