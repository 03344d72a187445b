"""First lines of many files: a task opens each file and reads one block of it.

Files are listed by Spark without their contents; the listing is dealt out over tasks, which open the
files themselves.  Where tasks cannot open a store that Spark's readers can, those readers give the lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.staging import settle

# Bytes read at a time; one block holds the first line of nearly every file.
BLOCK = 64 * 1024
# The byte order mark that some programs put first.
MARK = "\ufeff"


def listed(spark: SparkSession, folders: Sequence[str], pattern: str, recursive: bool, kind: str) -> DataFrame:
    """The files of folders, opened by one of Spark's readers."""
    reader = spark.read.format(kind).option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(list(folders))


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def first_line(path: str, block: int = BLOCK) -> str | None:
    """The first line of a file, unpacked by its ending; None where the store cannot be opened from here."""
    local = urlsplit(path).scheme in ("", "file")
    try:
        store, inside = open_store(path)
        stream = store.open_input_stream(inside, compression="detect", buffer_size=block)
    except (OSError, ImportError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        if local:
            raise
        return None
    with stream:
        held = b""
        while b"\n" not in held:
            more = stream.read(block)
            if not more:
                break
            held += more
    return held.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace").removeprefix(MARK)


def first_lines(spark: SparkSession, folders: Sequence[str], pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """``(path, header)`` of every file that holds something, stored once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [first_line(path) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["path", "header"])

    files = listed(spark, folders, pattern, recursive, "binaryFile").where(F.col("length") > 0).select("path")
    found = settle(files.mapInArrow(read, "path string, header string"))
    if not found.where(F.col("header").isNull()).isEmpty():
        found = settle(_by_spark(spark, folders, pattern, recursive))
    return found.where(F.col("header") != "")


def _by_spark(spark: SparkSession, folders: Sequence[str], pattern: str, recursive: bool) -> DataFrame:
    """The same from Spark's own reader, which reads the files to the end."""
    lines = listed(spark, folders, pattern, recursive, "text").select(
        "value",
        F.url_decode("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_n"),
    )
    return lines.where(F.col("_at") == 0).groupBy("path").agg(
        F.regexp_replace(F.min_by("value", "_n"), f"^{MARK}", "").alias("header")
    )
