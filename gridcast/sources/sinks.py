"""Writers.  Files are sized by ``maxRecordsPerFile``; nothing is gathered to one task."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcast.functions.text import run_key
from gridcast.operators.quality import canonical_sort

ROWS_PER_FILE = 5_000_000
# Files of a table of blocks.
BUCKETS = 32


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: Sequence[str] = ()
) -> None:
    writer = df.write.format(fmt).mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)


def append_readings(readings: DataFrame, path: str, fmt: str = "csv") -> None:
    """Adds rows to a table; every file has its own header line."""
    write_table(readings, path, fmt, mode="append")


def committed(spark: SparkSession, path: str) -> list[str]:
    """Batches of an append table that are complete: one small row each, in a hidden folder of the table."""
    try:
        return sorted(r["batch"] for r in spark.read.schema("batch string").json(f"{path}/_committed").distinct().collect())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []


def append_batch(readings: DataFrame, path: str, batch: str, fmt: str = "parquet") -> bool:
    """Adds a batch once: whether it was written now.

    A batch has a folder of its own.  What a failed attempt left there is replaced, and a batch that is
    committed is not written again, so an append may be repeated after any failure.
    """
    spark = readings.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9.-]+", batch):
        raise ValueError(f"not a name for a batch: {batch!r}")
    if batch in committed(spark, path):
        return False
    write_table(readings, f"{path}/batch={batch}", fmt, mode="overwrite")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").json(f"{path}/_committed")
    return True


def read_batches(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Rows of the committed batches of an append table; those of unfinished ones are not seen."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    folders = [f"{path}/batch={b}" for b in committed(spark, path)]
    return reader.load(folders) if folders else spark.createDataFrame([], schema)


def write_sorted(readings: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(canonical_sort(readings), path, fmt)


def write_by_year_and_station(readings: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One folder per year and station, in place of one file per input.

    A column ``fy`` is used when there is one, else the calendar year.
    """
    tagged = readings if "fy" in readings.columns else readings.withColumn("fy", F.year("datetime"))
    write_table(tagged, path, fmt, mode, by=["fy", "station"])


def write_windows(windows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Window arrays by station id; arrays of float are enough for training."""
    arrays = {c: F.col(c).cast("array<float>") for c in ("x", "y")}
    write_table(windows.withColumns(arrays), path, mode=mode, by=["station_id"])


def _table_name(path: str) -> str:
    return "blocks_" + hashlib.md5(path.encode()).hexdigest()


def write_blocks(df: DataFrame, path: str, keys: Sequence[str] = ("station", "part"), buckets: int = BUCKETS) -> DataFrame:
    """Stores rows in buckets by ``keys``, one file each, so that tables stored alike join without an exchange."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
    dealt = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
    dealt.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(_table_name(path))
    return spark.table(_table_name(path))


def read_blocks(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str] = ("station", "part"), buckets: int = BUCKETS) -> DataFrame:
    """A table that ``write_blocks`` stored, also in another session: the layout is named again, the files are where they were."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_table_name(path)} ({columns}) USING parquet "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_table_name(path))


def write_marks(marks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``([station,] t, emb)``; the order is in ``t``."""
    write_table(marks, path, mode=mode)


def wide_forecast(forecasts: DataFrame, horizon: int, key: str = "id") -> DataFrame:
    """``id, V1 … Vh``."""
    points = [F.get("forecast", F.lit(i)).alias(f"V{i + 1}") for i in range(horizon)]
    return forecasts.select(key, *points)


def write_forecasts(forecasts: DataFrame, horizon: int, pattern: str, path: str) -> None:
    write_table(wide_forecast(forecasts, horizon), f"{path}/{pattern}_forecast", "csv")


def log_metrics(metrics: DataFrame, settings: Mapping[str, object], path: str) -> None:
    """Appends ``(run_key, metric, value)`` rows of a one-row metric table."""
    doubles = [F.col(c).cast("double").alias(c) for c in metrics.columns]
    rows = metrics.select(F.lit(run_key(settings)).alias("run_key"), *doubles).unpivot(
        ["run_key"], metrics.columns, "metric", "value"
    )
    write_table(rows, path, mode="append")


def write_key_list(df: DataFrame, key: str, path: str) -> None:
    """Sorted distinct keys, such as dropped stations or dates."""
    write_table(df.select(key).distinct().orderBy(key), path, "csv")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
