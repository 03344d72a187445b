"""Names: stations, file names, clock-labelled columns, run keys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridcast.functions.columns import as_col

# Clock-column layouts and file-name decorations.
STRICT_CLOCK = r"^\d{2}:\d{2}$"
LOOSE_CLOCK = r"^\d{1,2}:\d{2}$"
YEAR_TAG = r"\s+FY\d{4}$"
LONG_TAG = r"_long$"
VOLTAGE_TAG = r"(?i)\s+\S*kv\S*$"


def clock_columns(names: Sequence[str], strict: bool = False) -> list[str]:
    """Column names that are clock times, in table order."""
    layout = re.compile(STRICT_CLOCK if strict else LOOSE_CLOCK)
    return [n for n in names if layout.match(n)]


def is_clock(name: Column | str, strict: bool = False) -> Column:
    return as_col(name).rlike(STRICT_CLOCK if strict else LOOSE_CLOCK)


def station_from_file_name(file_name: Column | str) -> Column:
    """Station part of a file name: extension, ``_long`` and year tag removed."""
    stem = F.regexp_replace(as_col(file_name), r"\.csv$", "")
    stem = F.regexp_replace(stem, LONG_TAG, "")
    return F.trim(F.regexp_replace(stem, YEAR_TAG, ""))


def file_name_of(path: Column | str) -> Column:
    """Last part of a path as Spark reports it, with its escapes undone."""
    last = F.element_at(F.split(as_col(path), "/"), -1)
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def strip_voltage_tag(station: Column | str) -> Column:
    """Drop a trailing voltage word such as ``66_11kV``; blanks collapse only then."""
    tidy = F.trim(as_col(station))
    has_tag = tidy.rlike(VOLTAGE_TAG)
    bare = F.regexp_replace(F.regexp_replace(tidy, VOLTAGE_TAG, ""), r"\s+", " ")
    return F.when(has_tag, F.trim(bare)).otherwise(tidy)


def run_key(settings: Mapping[str, object]) -> str:
    """Readable key of one run, every setting included (repeat number too)."""
    return "_".join(f"{name}{value}" for name, value in settings.items())


def run_key_column(settings: Mapping[str, Column]) -> Column:
    """The same key built from columns, for metric logs that hold many runs."""
    parts = [F.concat(F.lit(name), value.cast("string")) for name, value in settings.items()]
    return F.concat_ws("_", *parts)
