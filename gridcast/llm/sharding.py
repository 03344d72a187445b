"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size; shards take turns in
claiming the first slot of theirs that is free.  A key goes to the slot of its hash, whose shard the
table tells.  When shards come or go, most slots keep their shard.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

SIZE = 65_537
FILE_BYTES = 128 * 1024 * 1024
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def fill(shards: list[str] | tuple[str, ...], size: int = SIZE) -> list[str]:
    """The shard of each slot.  The order of ``shards`` and repeats in it make no difference."""
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    names = sorted(set(shards))
    if not names or len(names) > size:
        raise ValueError("there must be from one shard to as many as slots")
    table: list[str | None] = [None] * size
    at = [xxhash.xxh3_64_intdigest(n, seed=1) % size for n in names]
    skip = [xxhash.xxh3_64_intdigest(n, seed=2) % (size - 1) + 1 for n in names]
    free = size
    while free:
        for i, name in enumerate(names):
            while table[at[i]] is not None:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = name
            free -= 1
            if not free:
                break
    return table


def place(docs: DataFrame, shards: list[str] | tuple[str, ...] = SHARDS, key_col: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``docs`` with slot and shard of each row, by one broadcast of the table, whose size is fixed.

    Rows of equal keys share a shard, rows with a null key the slot of the empty text.  Columns named slot
    and shard are replaced, others are kept; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(fill(shards, size))), "slot int, shard string")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    slotted = docs.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(key), F.lit(size)).cast("int"))
    return slotted.join(F.broadcast(table), "slot", "left").select(*docs.drop("slot", "shard").columns, "slot", "shard")


def write(
    docs: DataFrame, path: str, shards: list[str] | tuple[str, ...] = SHARDS, key_col: str = "doc_id", file_bytes: int = FILE_BYTES, size: int = SIZE
) -> None:
    """Writes one folder for each shard, in files of about ``file_bytes`` of text and binary data each.

    The bytes of each shard are measured first (one number for each shard).  Rows are dealt out to a shard's
    files by their place in the input, not by key, so a key that many rows share, null among them, fills
    many files.  An empty table makes an empty folder; other cases are those of ``place``.
    """
    placed = place(docs, shards, key_col, size)
    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in docs.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    width = F.lit(8 * len(docs.columns)).cast("long")
    for w in wide:
        width = width + w
    files = placed.groupBy("shard").agg(F.greatest(F.ceil(F.sum(width) / file_bytes), F.lit(1)).cast("long").alias("_files")).collect()
    held = docs.sparkSession.createDataFrame([tuple(r) for r in files], "shard string, _files long")
    dealt = placed.join(F.broadcast(held), "shard").withColumn("_file", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_files")))
    tasks = max(1, sum(r["_files"] for r in files))
    dealt.repartition(tasks, "shard", "_file").drop("_files", "_file").write.partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all shards; ``schema`` is that of the documents written."""
    fields = [f for f in schema.fields if f.name not in ("slot", "shard")]
    return spark.read.schema(StructType(fields).add("slot", "integer").add("shard", "string")).parquet(path)
