"""Sliding windows.

Windows are described first (three integers each) and cut last.  A series is
held as array blocks: (station, block) with ``overlap`` extra points from the
blocks behind, so that every window that starts in a block can be cut from that
one row.  Arrays are built where the rows of a block lie; only the first points of
a block, which the block before needs, are sent.  Work spreads over blocks, not
stations, and a block has a fixed maximum size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.permute import Permutation
from gridcast.functions.vectors import tail
from gridcast.operators.axis import positions
from gridcast.operators.grid import BLOCK_ROWS
from gridcast.operators.split import RANK_BLOCK, Ranges
from gridcast.staging import small_side, spread

# Points of a block where the table has no blocks of its own.
BLOCK_POINTS = 2048


def block_size(df: DataFrame, keys: Sequence[str], block_points: int | None) -> int:
    """Points of a block: those of a grid's own blocks unless a size is asked for."""
    if block_points is not None:
        return block_points
    return BLOCK_ROWS if "block" in df.columns and "block" not in keys else BLOCK_POINTS


def series_blocks(
    df: DataFrame,
    overlap: int,
    keys: Sequence[str] = ("station",),
    t: str = "t",
    value: str = "target",
    block_points: int | None = None,
    first: int = 0,
) -> DataFrame:
    """``(keys, part, base, points)``: points from position ``base`` on, in order.

    Every series begins at position ``first``.  Positions must be dense within a key; a gap or a repeat fails the job.  At most ``block_points + overlap``
    points per row.  A table that still has the ``block`` of its grid is taken by those blocks, which lie
    together already; else its points are brought together once.
    """
    size = block_size(df, keys, block_points)
    pos = F.col(t).cast("long")
    if block_points is None and size == BLOCK_ROWS:
        rows = df.select(*keys, F.col("block").alias("part"), pos.alias("_t"), F.col(value).alias("_y"))
    else:
        rows = df.select(*keys, F.floor((pos - first) / size).cast("long").alias("part"), pos.alias("_t"), F.col(value).alias("_y"))
        rows = spread(rows, *keys, "part")
    base = F.col("part") * size + first
    own = F.when(_dense("_p", base), F.transform("_p", lambda p: p["_y"])).otherwise(_gaps())
    bodies = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("_t", "_y"))).alias("_p"))
    bodies = bodies.select(*keys, "part", own.alias("points"))
    if overlap <= 0:
        return bodies.select(*keys, "part", base.alias("base"), "points")
    # A long overlap reaches over several blocks.
    reach = -(-overlap // size)
    heads = bodies.select(*keys, F.col("part").alias("_from"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_k"), "points")
    sent = F.slice("points", F.lit(1), F.least(F.lit(size), F.lit(overlap) - (F.col("_k") - 1) * size).cast("int"))
    heads = spread(heads.where("_from >= _k").select(*keys, (F.col("_from") - F.col("_k")).alias("part"), "_k", sent.alias("_head")), *keys, "part")
    if reach > 1:
        heads = heads.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("_k", "_head"))).alias("_h"))
        whole = F.forall("_h", lambda h: (h["_k"] == F.size("_h")) | (F.size(h["_head"]) == size))
        in_row = (F.element_at("_h", -1)["_k"] == F.size("_h")) & whole
        heads = heads.select(*keys, "part", F.when(in_row, F.flatten(F.transform("_h", lambda h: h["_head"]))).otherwise(_gaps()).alias("_head"))
    joined = F.when(F.col("_head").isNull(), F.col("points")).when(F.size("points") == size, F.concat("points", "_head")).otherwise(_gaps())
    null_safe = [F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")) for c in keys]
    met = bodies.alias("b").join(heads.alias("h"), [F.col("b.part") == F.col("h.part"), *null_safe], "left")
    return met.select(*[F.col(f"b.{c}") for c in keys], F.col("b.part"), (F.col("b.part") * size + first).alias("base"), joined.alias("points"))


def _gaps() -> Column:
    return F.raise_error(F.lit("positions have gaps or repeats: put the series on a grid first"))


def _dense(points: str, base: Column) -> Column:
    """Whether sorted points take each position from ``base`` on once."""
    first, last = F.element_at(points, 1)["_t"], F.element_at(points, -1)["_t"]
    return (first == base) & (last - base + 1 == F.size(points))


def _starts(lo: Column, hi: Column) -> Column:
    """Integers from ``lo`` to ``hi``, none when ``hi < lo``."""
    return F.when(hi >= lo, F.sequence(lo, hi))


def starts_in_blocks(
    blocks: DataFrame, length: int, ranges: Ranges, block_points: int, last_shift: int = 0
) -> DataFrame:
    """Adds ``split`` and ``s_begin`` for every full window of ``length`` points.

    A window lies wholly inside its split; a split that is too short gives no
    rows.  ``last_shift`` 1 leaves out the last legal start.
    """
    per_split = blocks.select("*", F.explode(ranges.array()).alias("_r"))
    lo = F.greatest(F.col("_r.start"), F.col("base"))
    hi = F.least(F.col("_r.end") - length - last_shift, F.col("base") + (block_points - 1))
    return per_split.select(
        *blocks.columns, F.col("_r.split").alias("split"), F.explode(_starts(lo, hi)).alias("s_begin")
    )


def windows_index(
    series: DataFrame,
    length: int,
    ranges: Ranges,
    keys: Sequence[str] = ("station",),
    block_points: int = BLOCK_POINTS,
    size: str = "n",
) -> DataFrame:
    """``(keys, split, s_begin)`` from one row per series; no points are touched.

    ``series`` has one row per key with its length in ``size``; the starts are
    opened up block by block.
    """
    parts = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col(size) - 1, F.lit(0)) / block_points).cast("long"))
    opened = series.select(*series.columns, F.explode(parts).alias("part")).withColumn(
        "base", F.col("part") * block_points
    )
    return starts_in_blocks(spread(opened, *keys, "part"), length, ranges, block_points).select(*keys, "split", "s_begin")


def keep_contiguous(index: DataFrame, starts: DataFrame) -> DataFrame:
    """Windows whose start is listed by ``contiguous_starts``."""
    return index.join(small_side(starts.select(F.col("t").alias("s_begin"))), "s_begin", "left_semi")


def cut(points: Column, base: Column, start: Column, length: int) -> Column:
    """``length`` points from absolute position ``start``."""
    return F.slice(points, (start - base + 1).cast("int"), F.lit(length))


def windows(
    df: DataFrame,
    seq_len: int,
    label_len: int,
    pred_len: int,
    ranges: Ranges,
    keys: Sequence[str] = ("station",),
    t: str = "t",
    value: str = "target",
    block_points: int | None = None,
    carry: Sequence[str] = (),
    last_shift: int = 0,
    first: int = 0,
) -> DataFrame:
    """``(keys, split, s_begin, x, y)``.

    ``x`` has ``seq_len`` points from ``s_begin``; ``y`` repeats the last
    ``label_len`` of them and goes on for ``pred_len`` points.  ``carry`` names
    columns that are constant per key and needed by ``ranges``.  A series that ends inside a
    window fails the job.  ``first`` is the position that every series begins at, where the grid was made for a span.
    """
    length = seq_len + pred_len
    size = block_size(df, [*keys, *carry], block_points)
    # Where all ranges end inside the first block, no window reaches into another: arrays are made once and none is sent.
    ends = [hi for _, hi in ranges.bounds.values()]
    alone = all(isinstance(hi, int) and hi - first <= size for hi in ends)
    blocks = series_blocks(df, 0 if alone else length - 1, [*keys, *carry], t, value, block_points, first)
    placed = starts_in_blocks(blocks, length, ranges, size, last_shift)
    b, s = F.col("base"), F.col("s_begin")
    p = F.when(s - b + length <= F.size("points"), F.col("points")).otherwise(_gaps())
    return placed.select(
        *keys,
        "split",
        "s_begin",
        cut(p, b, s, seq_len).alias("x"),
        cut(p, b, s + (seq_len - label_len), label_len + pred_len).alias("y"),
    )


def precut_pairs(
    df: DataFrame,
    seq_len: int,
    pred_len: int,
    length: int | Column,
    keys: Sequence[str] = ("station",),
    include_last: bool = True,
    value: str = "target",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(keys, s_begin, x, y)`` with ``y`` the future only, over the whole series."""
    whole = Ranges({"all": (0, length)})
    return windows(
        df, seq_len, 0, pred_len, whole, keys, value=value, carry=carry, last_shift=0 if include_last else 1
    ).drop("split")


def with_label_tail(pairs: DataFrame, label_len: int) -> DataFrame:
    """Puts the last ``label_len`` points of ``x`` in front of ``y``."""
    return pairs.withColumn("y", F.concat(tail(F.col("x"), label_len), F.col("y")))


def unequal_lengths(pairs: DataFrame) -> DataFrame:
    """Counts of samples whose arrays are absent or not of the common length, the longest there is; one scan."""
    sizes = pairs.groupBy(F.size("x").alias("nx"), F.size("y").alias("ny"), F.col("station_id").isNull().alias("lost")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each combination of lengths.
    kinds = sizes.agg(F.collect_list(F.struct("nx", "ny", "lost", "n")).alias("k"))

    def of(column: str):
        top = F.array_max(F.transform("k", lambda r: F.coalesce(r[column], F.lit(-1))))
        return total(lambda r: F.coalesce(r[column], F.lit(-1)) != F.when(top >= 0, top).otherwise(F.lit(-2)))

    def total(keep):
        return F.aggregate(F.filter("k", keep), F.lit(0).cast("long"), lambda s, r: s + r["n"])

    return kinds.select(
        total(lambda r: F.lit(True)).alias("samples"), of("nx").alias("bad_x"), of("ny").alias("bad_y"), total(lambda r: r["lost"]).alias("bad_station")
    )


def shuffled_batches(
    samples: DataFrame, seed: int, batch_size: int, ids: Sequence[str], drop_last: bool = True, rows: int | None = None
) -> DataFrame:
    """Seeded random order as ``(position, batch)``.

    Samples are numbered along ``ids``, the last of which is an integer, and a keyed permutation of the
    numbers tells their positions: no sort by hash, and the same order whatever the partitioning.  ``rows`` is
    the number of samples where it is known.  ``drop_last`` leaves out an incomplete last batch.
    """
    total = samples.count() if rows is None else rows
    cuts = {f"_b{i}": F.col(c) for i, c in enumerate(ids[:-1])} | {"_part": F.floor(F.col(ids[-1]) / RANK_BLOCK)}
    numbered = positions(samples, [ids[-1]], cuts, "_i")
    shuffled = numbered.withColumn("position", Permutation(total, seed).column(F.col("_i"))).drop("_i")
    batched = shuffled.withColumn("batch", F.floor(F.col("position") / batch_size).cast("long"))
    return batched.where(F.col("batch") < total // batch_size) if drop_last else batched
