"""Date-time expressions on naive timestamps.

Every expression stays on ``TIMESTAMP_NTZ`` so that the session time zone can
never shift a reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridcast.functions.columns import as_col

NAIVE = "timestamp_ntz"
# Fixed value: seconds from 0001-01-01 to 1970-01-01.
YEAR_ONE_SECONDS = 62_135_596_800

# Layouts tried after ISO dates and times, in this order.
DATETIME_FORMATS = (
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    "ddMMMyyyy",
)
STRICT_DATE_FORMAT = "ddMMMyyyy"


def _naive(text: str) -> Column:
    return F.lit(text).cast(NAIVE)


def seconds_interval(seconds: Column | str) -> Column:
    """Interval of a whole number of seconds."""
    return F.expr("INTERVAL '1' SECOND") * as_col(seconds)


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 of a naive timestamp, with no zone conversion.

    Counted from year 1 so that earlier times round down as well.
    """
    since = as_col(ts) - _naive("0001-01-01 00:00:00")
    return since.cast("interval second").cast("bigint") - F.lit(YEAR_ONE_SECONDS)


def from_epoch_seconds(seconds: Column | str) -> Column:
    """Inverse of :func:`epoch_seconds`."""
    return _naive("1970-01-01 00:00:00") + seconds_interval(seconds)


def floor_time(ts: Column | str, step_seconds: int) -> Column:
    """Start of the ``step_seconds`` bucket that holds ``ts``."""
    secs = epoch_seconds(ts)
    return from_epoch_seconds(secs - F.pmod(secs, F.lit(step_seconds)))


def day_of(ts: Column | str) -> Column:
    return as_col(ts).cast("date")


def iso_day(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd")


def _parse(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast(NAIVE)


def parse_datetime(text: Column | str, formats: Sequence[str] = DATETIME_FORMATS) -> Column:
    """Lenient parse: ISO first, then the first layout that fits, NULL when none does.

    A date such as 03/04/2021 is read month first.
    """
    text = F.trim(as_col(text))
    return F.coalesce(text.try_cast(NAIVE), *[_parse(text, fmt) for fmt in formats])


def parse_strict_date(text: Column | str) -> Column:
    """``01May2021`` in any letter case; NULL when malformed (callers reject or raise)."""
    tidy = F.upper(F.trim(as_col(text)))
    shaped = F.when(tidy.rlike(r"^\d{2}[A-Z]{3}\d{4}$"), tidy)
    return _parse(shaped, STRICT_DATE_FORMAT).cast("date")


def compose_datetime(day: Column | str, hhmm: Column | str) -> Column:
    """Calendar day plus an ``HH:MM`` label."""
    parts = F.split(as_col(hhmm), ":")
    offset = F.make_dt_interval(F.lit(0), parts[0].cast("int"), parts[1].cast("int"))
    return as_col(day).cast("date").cast(NAIVE) + offset


def span_prompt(start: Column | str, token_len: int, step_minutes: int) -> Column:
    """Text naming the span of one token that starts at ``start``."""
    start = as_col(start)
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit((token_len - 1) * step_minutes))
    layout = "yyyy-MM-dd HH:mm:ss"
    # Fixed value: the sentence must read exactly like this.
    return F.format_string(
        "This is Time Series from %s to %s.",
        F.date_format(start, layout),
        F.date_format(end, layout),
    )
