"""Series collections: ``.tsf`` text, channel tables, bare matrices, grouped series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.numbers import nan_to_null, parse_number
from gridcast.functions.times import NAIVE, parse_datetime
from gridcast.operators.axis import positions

# Text encoding (cp1252, read byte by byte, then mapped), value marker and date layout of the format.
READ_ENCODING = "iso-8859-1"
TSF_MISSING = "?"
TSF_DATE = "yyyy-MM-dd HH-mm-ss"
TRUE_WORDS = ("y", "yes", "t", "true", "on", "1")
FALSE_WORDS = ("n", "no", "f", "false", "off", "0")
# Bytes that cp1252 maps to another character than Latin-1 does.
_HIGH = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
LATIN_1, CP1252 = ("".join(part) for part in zip(*[(a, c) for a, c in _HIGH if c]))
# A character that text files do not hold, so that each line is one CSV field.
NO_SEPARATOR = "\u0001"


@dataclass(frozen=True)
class Collection:
    series: DataFrame
    rejects: DataFrame
    frequency: str | None
    horizon: int | None
    missing: bool | None
    equal_length: bool | None


def _truth(word: str) -> bool:
    low = word.lower()
    if low not in TRUE_WORDS + FALSE_WORDS:
        raise ValueError(f"not a truth value: {word!r}")
    return low in TRUE_WORDS


def _attribute(text: Column, kind: str) -> Column:
    if kind == "numeric":
        return text.try_cast("long")
    if kind == "string":
        return text
    if kind == "date":
        return F.try_to_timestamp(text, F.lit(TSF_DATE)).cast(NAIVE)
    raise ValueError(f"unknown attribute type {kind!r}")


def read_tsf(spark: SparkSession, path: str, value: str = "series_value", strict: bool = False) -> Collection:
    """Typed attributes and one value array per series.

    The header ends at the @data line and is read on the driver; data lines stay distributed.
    Lines with a wrong field count, a bad attribute, a bad number or no value at
    all are rejected with a reason, or fail the job in strict mode.
    """
    lines = (
        spark.read.schema("line string")
        .option("encoding", READ_ENCODING)
        .option("sep", NO_SEPARATOR)
        .option("quote", "")
        .option("escape", "")
        .csv(path)
        .select(F.translate(F.trim("line"), LATIN_1, CP1252).alias("line"))
        .where(F.length("line") > 0)
    )
    meta = []
    # Partition by partition, in the order of the file: it ends with the part that has the @data line.
    for row in lines.where(F.col("line").startswith("@")).toLocalIterator():
        meta.append(row["line"])
        if row["line"].split(" ")[0].startswith("@data"):
            break
    names: list[tuple[str, str]] = []
    found: dict[str, str] = {}
    for line in meta:
        words = line.split(" ")
        if words[0].startswith("@data"):
            found["@data"] = ""
            continue
        expected = 3 if words[0] == "@attribute" else 2
        if len(words) != expected:
            raise ValueError(f"invalid header line: {line!r}")
        if expected == 3:
            names.append((words[1], words[2]))
        else:
            found[words[0]] = words[1]
    if not names:
        raise ValueError("no attribute section")
    if "@data" not in found:
        raise ValueError("no @data line")

    data = lines.where(~F.col("line").startswith("@") & ~F.col("line").startswith("#"))
    fields = F.split("line", ":")
    cells = F.split(F.element_at("_f", -1), ",")
    is_gap = lambda c: F.trim(c) == TSF_MISSING
    parsed = (
        data.withColumn("_f", fields)
        .withColumn("_ok", F.size("_f") == len(names) + 1)
        .withColumn("_cells", F.when(F.col("_ok"), cells))
        .withColumn(value, F.transform("_cells", lambda c: parse_number(c)))
    )
    columns = {n: _attribute(F.when(F.col("_ok"), F.get("_f", F.lit(i))), k) for i, (n, k) in enumerate(names)}
    typed = parsed.withColumns(columns)
    bad_attribute = F.lit(False)
    for n, _ in names:
        bad_attribute = bad_attribute | F.col(n).isNull()
    bad_number = F.exists(F.arrays_zip("_cells", value), lambda z: ~is_gap(z["_cells"]) & z[value].isNull())
    reason = (
        F.when(~F.col("_ok"), "wrong number of fields")
        .when(bad_attribute, "bad attribute")
        .when(~F.exists("_cells", lambda c: ~is_gap(c)), "all values missing")
        .when(bad_number, "bad number")
    )
    judged = typed.withColumn("reason", reason)
    attribute_names = [n for n, _ in names]
    if strict:
        checked = F.when(F.col("reason").isNull(), F.col(value)).otherwise(
            F.raise_error(F.concat(F.col("reason"), F.lit(": "), F.substring("line", 1, 80))).cast("array<double>")
        )
        series = judged.select(*attribute_names, checked.alias(value))
    else:
        series = judged.where(F.col("reason").isNull()).select(*attribute_names, value)
    rejects = judged.where(F.col("reason").isNotNull()).select("line", "reason")
    return Collection(
        series,
        rejects,
        found.get("@frequency"),
        int(found["@horizon"]) if "@horizon" in found else None,
        _truth(found["@missing"]) if "@missing" in found else None,
        _truth(found["@equallength"]) if "@equallength" in found else None,
    )


def series_rows(collection: DataFrame, key: str, value: str = "series_value") -> DataFrame:
    """``(series, t, y)`` from array rows."""
    return collection.select(F.col(key).alias("series"), F.posexplode(value).alias("t", "y")).withColumn(
        "t", F.col("t").cast("long")
    )


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """``(datetime, channel, value)``: the first column is the time, all others are channels."""
    wide = spark.read.option("header", True).csv(path)
    time, *channels = wide.columns
    return channel_rows(wide, time, channels).select(
        parse_datetime("datetime").alias("datetime"), "channel", parse_number("value").alias("value")
    )


def channel_rows(wide: DataFrame, time: str, channels: list[str]) -> DataFrame:
    return wide.withColumnRenamed(time, "datetime").unpivot(
        ["datetime"], [F.col(f"`{c}`") for c in channels], "channel", "value"
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(path, t, channel, value)`` of comma-separated lines without header or time.

    ``t`` is the line number in its file.  Lines are numbered inside each file
    split and shifted by the sizes of the splits before it, so a file of any
    size is read in parallel.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_n"),
    )
    numbered = positions(lines, ["_n"], {"_split": F.col("_at")}, "t", keys=["path"])
    cells = numbered.select("path", "t", F.posexplode(F.split("value", ",")).alias("channel", "_cell"))
    return cells.select("path", "t", "channel", parse_number("_cell").alias("value"))


def read_group(spark: SparkSession, path: str, group: str) -> DataFrame:
    """``(id, grp, series)`` of one seasonal pattern; the filter reaches the scan."""
    return spark.read.parquet(path).select("id", "grp", "series").where(F.col("grp") == group)
