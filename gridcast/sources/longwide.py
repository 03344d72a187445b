"""Readings in CSV files, long or wide, one file per station and year or many.

Headers are read from one block of each file and grouped in Spark, so the number of
reads follows the number of layouts, not of files.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridcast.functions.numbers import MISSING_TOKENS, parse_number
from gridcast.functions.text import clock_columns, file_name_of, station_from_file_name
from gridcast.functions.times import compose_datetime, parse_datetime, parse_strict_date
from gridcast.operators.clean import LONG_COLUMNS
from gridcast.sources.headers import first_lines, listed
from gridcast.staging import small_side

CORRUPT = "_corrupt"
LONG_SCHEMA = "datetime string, station string, target string"


@dataclass(frozen=True)
class Layout:
    """One distinct header and where it is found: folders all of whose files have it, and other files."""

    columns: tuple[str, ...]
    header: str
    pattern: str
    paths: tuple[str, ...]

    @property
    def clocks(self) -> list[str]:
        return clock_columns(self.columns)

    @property
    def kind(self) -> str:
        if "datetime" in self.columns and "target" in self.columns:
            return "long"
        if self.clocks and ("Date" in self.columns or "date" in self.columns):
            return "wide"
        return "unknown"


@dataclass(frozen=True)
class Scan:
    """Readings plus what could not be read."""

    readings: DataFrame
    rejects: DataFrame


def present_folders(spark: SparkSession, folders: Sequence[str], pattern: str, recursive: bool = False) -> list[str]:
    kept = []
    for folder in folders:
        try:
            listed(spark, [folder], pattern, recursive, "text")
            kept.append(folder)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return kept


def literal(path: Column) -> Column:
    """A path as one to read: glob characters taken literally."""
    return F.regexp_replace(path, r"([\\*?\[\]{}])", r"\\$1")


def group_layouts(firsts: DataFrame, pattern: str) -> list[Layout]:
    """Layouts of files from their first lines.

    A folder whose files share one header is read as a folder, unless there are files in folders beneath it;
    only files of mixed folders come to the driver one by one.
    """
    placed = firsts.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    folders = placed.groupBy("folder").agg(F.min("header").alias("header"), F.max("header").alias("other"))
    kinds = folders.select(literal(F.col("folder")).alias("place"), "folder", "header", (F.col("header") == F.col("other")).alias("whole")).collect()
    parents = {up for k in kinds for up in _above(k["folder"])}
    whole = {k["folder"] for k in kinds if k["whole"] and k["folder"] not in parents}
    by_header: dict[str, list[str]] = {}
    for k in kinds:
        if k["folder"] in whole:
            by_header.setdefault(k["header"], []).append(k["place"])
    if len(whole) < len(kinds):
        mixed = firsts.sparkSession.createDataFrame([(k["folder"],) for k in kinds if k["folder"] not in whole], "folder string")
        for row in placed.join(small_side(mixed), "folder").select("header", literal(F.col("path")).alias("place")).toLocalIterator():
            by_header.setdefault(row["header"], []).append(row["place"])
    found = []
    for header, paths in sorted(by_header.items()):
        names = next(csv.reader([header]))
        found.append(Layout(tuple(n.strip() for n in names), header, pattern, tuple(sorted(paths))))
    return found


def _above(folder: str) -> list[str]:
    """All folders that a folder lies in."""
    parts = folder.split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts))]


def layouts(spark: SparkSession, folders: Sequence[str], pattern: str = "*.csv", recursive: bool = False) -> list[Layout]:
    """Distinct headers with their places; missing folders are skipped."""
    return _found(spark, folders, pattern, recursive)[0]


def _found(spark: SparkSession, folders: Sequence[str], pattern: str, recursive: bool) -> tuple[list[Layout], DataFrame]:
    """Layouts, and ``(path, header)`` of the files."""
    kept = present_folders(spark, folders, pattern, recursive)
    firsts = first_lines(spark, kept, pattern, recursive) if kept else spark.createDataFrame([], "path string, header string")
    return (group_layouts(firsts, pattern) if kept else []), firsts


def read_layout(spark: SparkSession, layout: Layout) -> DataFrame:
    """All-string rows of one layout, with the source path and the malformed line, if any."""
    fields = [StructField(c, StringType()) for c in layout.columns] + [StructField(CORRUPT, StringType())]
    rows = (
        spark.read.schema(StructType(fields))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # Else fields are only counted up to the last column that is asked for.
        .option("columnPruning", False)
        .option("pathGlobFilter", layout.pattern)
        .csv(list(layout.paths))
    )
    return rows.withColumn("_path", F.col("_metadata.file_path"))


def tidy(text: Column) -> Column:
    """NULL for every token that means a missing reading."""
    return F.when(~F.trim(text).isin(*MISSING_TOKENS), text)


def unpivot_clocks(wide: DataFrame, ids: Sequence[str], strict: bool = False) -> DataFrame:
    """One row per clock column, empty readings kept."""
    clocks = clock_columns(wide.columns, strict)
    return wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in clocks], "time", "target")


def wide_to_long(wide: DataFrame, station: Column, day: Column, strict: bool = False) -> DataFrame:
    """Long readings from wide rows; ``day`` parses the date column.

    A line that cannot be read, by its number of fields or its date, gives one row: without time and reading, and with ``_bad``.
    """
    keep = wide.withColumn("_day", day).withColumn("_station", station)
    keep = keep.withColumn("_bad", F.coalesce(CORRUPT, F.when(F.col("_day").isNull(), "no date")))
    first = clock_columns(keep.columns, strict)[:1]
    long = unpivot_clocks(keep, ["_day", "_station", "_path", "_bad"], strict)
    long = long.where(F.col("_bad").isNull() | F.col("time").isin(first))
    long = long.withColumns({c: F.when(F.col("_bad").isNull(), F.col(c)) for c in ("_day", "target")})
    return long.select(
        compose_datetime("_day", "time").alias("datetime"),
        F.col("_station").alias("station"),
        parse_number(tidy(F.col("target"))).alias("target"),
        "_path",
        "_bad",
    )


def station_of(columns: Sequence[str], source: str = "auto") -> Column:
    """Station from the file name, from the substation column, or from the row if it has one."""
    by_name = station_from_file_name(file_name_of("_path"))
    if source == "filename":
        return by_name
    if source == "column":
        if "Zone Substation" not in columns:
            raise ValueError("no 'Zone Substation' column")
        return F.col("`Zone Substation`")
    if "station" in columns:
        return F.coalesce(tidy(F.col("station")), by_name)
    return by_name


def read_wide(
    spark: SparkSession,
    folders: Sequence[str],
    pattern: str = "*.csv",
    station_from: str = "filename",
    strict: bool = True,
    recursive: bool = True,
) -> DataFrame:
    """Wide files to ``(datetime, station, target)``.

    Files without clock columns give no rows.  In strict mode a date that is not
    like ``01MAY2021`` fails the job, as do a line with too many or too few fields and
    a wide file without ``Date``.  Else such lines give no rows; ``scan`` counts them.
    """
    parts = []
    for layout in layouts(spark, folders, pattern, recursive):
        clocks = clock_columns(layout.columns, strict)
        if not clocks:
            continue
        if "Date" not in layout.columns:
            raise ValueError(f"no 'Date' column in {layout.paths[0]}")
        day = parse_strict_date("Date") if strict else parse_datetime("Date").cast("date")
        if strict:
            day = F.coalesce(day, F.raise_error(F.concat(F.lit("bad date: "), F.coalesce("Date", F.lit("null")))).cast("date"))
        rows = read_layout(spark, layout)
        long = wide_to_long(rows, station_of(layout.columns, station_from), day, strict)
        fine = F.col("_bad").isNull()
        if strict:
            fine = F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("_bad"))).cast("boolean"))
        parts.append(long.where(fine).drop("_path", "_bad"))
    return union(parts, spark)


def union(parts: Sequence[DataFrame], spark: SparkSession) -> DataFrame:
    """Union of all parts by name; an empty readings table when there are none."""
    out = spark.createDataFrame([], "datetime timestamp_ntz, station string, target double")
    for i, part in enumerate(parts):
        out = part if i == 0 else out.unionByName(part, allowMissingColumns=True)
    return out


def scan(spark: SparkSession, folders: Sequence[str], pattern: str = "*.csv", recursive: bool = False) -> Scan:
    """Long and wide files side by side, with the reasons for what was left out.

    ``rejects`` is ``(path, reason, rows)``: unknown layouts, files without any
    valid time, and lines whose time or number of fields could not be read.
    """
    parts, unknown = [], []
    found, firsts = _found(spark, folders, pattern, recursive)
    for layout in found:
        if layout.kind == "unknown":
            unknown.append(layout.header)
            continue
        rows = read_layout(spark, layout)
        station = station_of(layout.columns)
        if layout.kind == "long":
            long = rows.select(
                parse_datetime("datetime").alias("datetime"),
                station.alias("station"),
                parse_number(tidy(F.col("target"))).alias("target"),
                "_path",
                F.col(CORRUPT).alias("_bad"),
            )
        else:
            name = "Date" if "Date" in layout.columns else "date"
            day = F.coalesce(parse_strict_date(name), parse_datetime(name).cast("date"))
            long = wide_to_long(rows, station, day)
        parts.append(long)
    rejects = firsts.where(F.col("header").isin(*unknown) if unknown else F.lit(False)).select(
        "path", F.lit("unrecognised columns").alias("reason"), F.lit(None).cast("long").alias("rows")
    )
    if not parts:
        return Scan(union([], spark), rejects)
    tagged = union(parts, spark)
    valid = F.col("datetime").isNotNull() & F.col("_bad").isNull()
    counts = tagged.groupBy(F.col("_path").alias("path")).agg(
        F.count_if(valid).alias("_good"), F.count_if(~valid).alias("rows")
    )
    reason = F.when(F.col("_good") == 0, "no valid datetime").otherwise("unreadable rows")
    bad = counts.where(F.col("rows") > 0).select("path", reason.alias("reason"), "rows")
    return Scan(tagged.where(valid).select(*LONG_COLUMNS), rejects.unionByName(bad))


def read_long(
    spark: SparkSession, folders: Sequence[str], pattern: str = "*_long.csv", columns: Sequence[str] = LONG_COLUMNS
) -> DataFrame:
    """Long files with a known schema; only the named columns are parsed."""
    kept = present_folders(spark, folders, pattern)
    if not kept:
        return union([], spark).select(*columns)
    rows = spark.read.schema(LONG_SCHEMA).option("header", True).option("pathGlobFilter", pattern).csv(kept)
    parsed = {
        "datetime": parse_datetime("datetime"),
        "station": F.col("station"),
        "target": parse_number(tidy(F.col("target"))),
    }
    return rows.select(*[parsed[c].alias(c) for c in columns])
