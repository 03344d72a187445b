"""Mark vectors (time or weather embeddings) for windows.

Marks come as a table ``(t, emb)``, or ``(station, t, emb)`` when they differ by
station.  They are held as array blocks with the same cut as the series, so a
window needs one join on (station,) block instead of one per mark position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from gridcast.functions import vectors as V
from gridcast.functions.times import span_prompt
from gridcast.operators.windows import series_blocks
from gridcast.staging import small_side

MARK_BLOCK = 256
# Windows that meet one copy of a block of shared marks.
WINDOWS_PER_COPY = 16_384
# Keys whose sums a task holds at a time.
HELD_KEYS = 4_096


def prompts(axis: DataFrame, token_len: int, step_minutes: int) -> DataFrame:
    """``(t, prompt)``: the sentence that names each token span."""
    return axis.select("t", span_prompt("datetime", token_len, step_minutes).alias("prompt"))


def check_marks(marks: DataFrame, axis: DataFrame, keys: Sequence[str] = (), stations: DataFrame | None = None) -> DataFrame:
    """One row with the counts of axis points, marked points and mismatches.

    ``stations`` lists the keys that must have marks; one without any counts as 0.

    ``ok`` tells whether every axis position (per station, when keyed) has a mark
    and no mark lies outside the axis.
    """
    points = axis.agg(F.count(F.lit(1))).scalar()
    outside = marks.join(axis.select("t"), "t", "left_anti").agg(F.count(F.lit(1))).scalar()
    per_key = marks.groupBy(*keys).agg(F.countDistinct("t").alias("marked")) if keys else marks.agg(
        F.countDistinct("t").alias("marked")
    )
    if keys and stations is not None:
        per_key = stations.select(*keys).distinct().join(per_key, list(keys), "left")
        per_key = per_key.withColumn("marked", F.coalesce("marked", F.lit(0)))
    return (
        per_key.agg(F.min("marked").alias("least_marked"), F.max("marked").alias("most_marked"))
        .withColumn("axis_points", points)
        .withColumn("outside", outside)
        .withColumn(
            "ok",
            (F.col("least_marked") == F.col("axis_points"))
            & (F.col("most_marked") == F.col("axis_points"))
            & (F.col("outside") == 0),
        )
    )


def stride_positions(start: Column, length: int, stride: int) -> Column:
    """``start, start+stride, …`` below ``start + length``."""
    return F.sequence(start, start + (length - 1), F.lit(stride).cast("long"))


def mark_positions(index: DataFrame, seq_len: int, label_len: int, pred_len: int, token_len: int) -> DataFrame:
    """Axis positions whose marks a window uses: every token of the lookback, then of the horizon."""
    s = F.col("s_begin")
    return index.select(
        "*",
        stride_positions(s, seq_len, token_len).alias("x_pos"),
        stride_positions(s + seq_len, pred_len, token_len).alias("y_pos"),
    )


def mark_blocks(marks: DataFrame, overlap: int, keys: Sequence[str] = (), block: int = MARK_BLOCK) -> DataFrame:
    return series_blocks(marks, overlap, keys, "t", "emb", block).withColumnRenamed("points", "marks")


def attach_marks(
    index: DataFrame,
    marks: DataFrame,
    seq_len: int,
    label_len: int,
    pred_len: int,
    token_len: int,
    keys: Sequence[str] = (),
    block: int = MARK_BLOCK,
    names: tuple[str, str] = ("x_mark", "y_mark"),
    windows_per_copy: int = WINDOWS_PER_COPY,
    copies: int | None = None,
) -> DataFrame:
    """Adds the mark arrays of every window; ``keys`` is ("station",) for per-station marks.

    Shared marks meet the windows of all stations in one block, so the windows of each
    block are counted first: a block is copied once for every ``windows_per_copy`` of
    them, or ``copies`` times, and they are dealt out among the copies.  A window without
    marks stays, with arrays of NULL.
    """
    parts = mark_blocks(marks, seq_len + pred_len - 1, keys, block)
    part = F.floor(F.col("s_begin") / block).cast("long")
    placed = mark_positions(index, seq_len, label_len, pred_len, token_len).withColumn("part", part)
    met = [*keys, "part"]
    if not keys:
        many = F.ceil(F.count(F.lit(1)) / windows_per_copy) if copies is None else F.max(F.lit(copies))
        counted = index.select(part.alias("part")).groupBy("part").agg(many.cast("long").alias("_copies"))
        # One row for each block of marks.
        counted = small_side(counted)
        parts = parts.join(counted, "part").select(*parts.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
        row = F.xxhash64(*[c for c in ("station", "series", "channel", "s_begin") if c in index.columns])
        placed = placed.join(counted, "part").withColumn("_copy", F.pmod(row, F.col("_copies"))).drop("_copies")
        met.append("_copy")
    joined = placed.join(parts, met, "left")

    def pick(pos: str) -> Column:
        return F.transform(pos, lambda i: F.get("marks", (i - F.col("base")).cast("int")))

    return joined.withColumn(names[0], pick("x_pos")).withColumn(names[1], pick("y_pos")).drop(
        "part", "base", "marks", "x_pos", "y_pos", "_copy"
    )


def marks_of_blocks(placed: DataFrame, blocks: DataFrame, names: tuple[str, str] = ("x_mark", "y_mark")) -> DataFrame:
    """Mark arrays of windows that name their ``station``, ``part`` and positions, from stored blocks of the same cut."""
    joined = placed.join(blocks.hint("merge"), ["station", "part"], "left")
    picked = {n: F.transform(p, lambda i: F.get("marks", (i - F.col("base")).cast("int"))) for n, p in zip(names, ("x_pos", "y_pos"), strict=True)}
    return joined.withColumns(picked).drop("part", "base", "marks", "x_pos", "y_pos")


def join_marks(time_marks: Column, weather_marks: Column) -> Column:
    """Weather vectors appended to time vectors, position by position."""
    return F.zip_with(time_marks, weather_marks, lambda a, b: F.concat(a, b))


def feed_future_mark(x_mark: Column, y_mark: Column, step: int) -> Column:
    """Marks of rollout step ``step`` (from 1): oldest x mark out, y mark ``step - 1`` in."""
    dropped = F.slice(x_mark, F.lit(2), F.size(x_mark) - 1)
    return F.concat(dropped, F.slice(y_mark, F.lit(step), F.lit(1)))


def keep_half(marks: Column, first: bool) -> Column:
    """Zeroes the weather half (``first``) or the time half of joined marks."""

    def mask(vec: Column) -> Column:
        half = F.floor(F.size(vec) / 2)
        keep = (lambda i: i < half) if first else (lambda i: i >= half)
        return F.transform(vec, lambda v, i: F.when(keep(i), v).otherwise(F.lit(0.0).cast("float")))

    return F.transform(marks, mask)


def vector_sums(rows: DataFrame, keys: Sequence[str], vector: str, weight: str) -> DataFrame:
    """``(keys, sums array<double>, weights)``: weighted sums of vectors, added up as whole arrays.

    Tasks give one array for each key they meet, so as many rows are shuffled as there are keys, times tasks.
    Null vectors and weights count for nothing; a null component counts as 0; shorter vectors are as if
    filled up with 0.
    """
    kept = rows.select(*keys, F.col(vector).cast("array<double>").alias("sums"), F.col(weight).cast("double").alias("weights")).dropna(subset=["sums", "weights"])
    schema = StructType([*kept.schema.fields[: len(keys)]]).add("sums", ArrayType(DoubleType())).add("weights", DoubleType())
    names = schema.names

    def total(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            flat = [[*k, *v] for k, v in held.items()]
            columns = list(zip(*flat, strict=True))
            kinds = [*(f.type for f in fields[: len(keys)]), pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        fields: list[pa.Field] = []
        for batch in batches:
            fields = list(batch.schema)
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            values, weights = batch.column(len(keys)), batch.column(len(keys) + 1).to_pylist()
            flat = np.nan_to_num(values.flatten().to_numpy(zero_copy_only=False), nan=0.0)
            ends = np.cumsum(np.asarray(values.value_lengths())).tolist()
            begin = 0
            for i, end in enumerate(ends):
                key = tuple(c[i] for c in columns)
                add = flat[begin:end] * weights[i] if weighted else flat[begin:end]
                begin = end
                now = held.get(key)
                if now is None:
                    held[key] = [add.copy(), weights[i]]
                else:
                    if len(now[0]) < len(add):
                        now[0] = np.pad(now[0], (0, len(add) - len(now[0])))
                    now[0][: len(add)] += add
                    now[1] += weights[i]
            if len(held) >= HELD_KEYS:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = kept.mapInArrow(lambda batches: total(batches, True), schema)
    if not keys:
        return parts.repartition(1).mapInArrow(lambda batches: total(batches, False), schema)
    gathered = parts.groupBy(*keys).agg(F.collect_list("sums").alias("_all"), F.sum("weights").alias("weights"))
    width = F.array_max(F.transform("_all", F.size))
    # At most one array for each task that met the key, or for each time it gave out what it held.
    sums = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate("_all", F.lit(0.0), lambda s, v: s + F.coalesce(F.get(v, i), F.lit(0.0))))
    return gathered.select(*keys, F.when(width > 0, sums).otherwise(F.array().cast("array<double>")).alias("sums"), "weights")


def masked_mean(tokens: DataFrame, keys: Sequence[str], vector: str = "vec", mask: str = "mask") -> DataFrame:
    """Mean of token vectors where ``mask`` is 1, per key, as ``(keys, emb)``."""
    pooled = vector_sums(tokens, keys, vector, mask)
    share = F.greatest(F.col("weights"), F.lit(1e-6))
    return pooled.select(*keys, F.transform("sums", lambda v: v / share).alias("emb"))


def mark_stats(marked: DataFrame, column: str = "x_mark") -> DataFrame:
    """Mean, sample deviation, minimum and maximum of all mark values, and the mean
    absolute change from the first to the second mark."""
    delta = V.array_sum(
        F.zip_with(
            F.get(column, F.lit(0)), F.get(column, F.lit(1)), lambda a, b: F.abs(b.cast("double") - a.cast("double"))
        )
    ) / F.size(F.get(column, F.lit(0)))
    flat = F.flatten(F.col(column).cast("array<array<double>>"))
    # One row of sums for each window: how many values, their mean, the squares of their distance from it.
    held = marked.select(delta.alias("_step"), F.filter(flat, lambda v: v.isNotNull()).alias("_v"))
    first = F.get("_v", F.lit(0))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    add = lambda a, v: F.struct((a["s"] + (v - first)).alias("s"), (a["q"] + (v - first) * (v - first)).alias("q"))
    summed = held.where("size(_v) > 0").select(F.size("_v").cast("double").alias("n"), F.aggregate("_v", zero, add).alias("a"), first.alias("f"), F.array_min("_v").alias("lo"), F.array_max("_v").alias("hi"))
    off = F.col("a.q") - F.col("a.s") * F.col("a.s") / F.col("n")
    rows = summed.select(F.struct("n", (F.col("f") + F.col("a.s") / F.col("n")).alias("m"), off.alias("d"), "lo", "hi").alias("_w"))
    w = lambda f: F.col(f"_w.{f}")
    # Weighted mean and spread of the windows' means, whose own deviations are added.
    centre = F.sum(w("n") * w("m")) / F.sum(w("n"))
    sums = rows.agg(
        centre.alias("mean"), F.sum(w("n")).alias("_n"), F.sum(w("d")).alias("_d"), F.sum(w("n") * w("m") * w("m")).alias("_mm"),
        F.min(w("lo")).alias("low"), F.max(w("hi")).alias("high"),
    ).withColumn("mean_step", held.agg(F.avg("_step")).scalar())
    spread = F.col("_d") + F.greatest(F.col("_mm") - F.col("_n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return sums.select("mean", F.sqrt(F.try_divide(spread, F.col("_n") - 1)).alias("sd"), "low", "high", "mean_step")
