"""Near-duplicate vectors by tiled comparison in the order of the principal components.

Unit vectors are rotated onto the principal axes of the corpus, so the first coordinates carry most
of a product.  Vectors of one label are dealt into blocks by hash, and each two blocks meet in one task,
which holds one of them and takes the other as it comes, both in tiles along the first axis.  A pair of
tiles, and then each pair of vectors, is given up once the product over the leading coordinates plus the
product of the norms of what follows cannot reach the threshold; what is left is computed exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.graph import components
from gridcast.llm.store import BROADCAST_VALUES, partitions, settle, slices

TILE = 512
# A block of vectors that a task holds; a label of over FULL vectors has two at least.
BLOCK_BYTES, FULL = 192 << 20, 1 << 16
# Slack for rounding in the rotated coordinates of single precision; what passes is judged on the vectors as given.
SLACK = 1e-5


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of doubles as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): vectors with an id and a label, not empty, not zero, all components finite.

    Each is scaled by a power of two, which changes no cosine, to a largest magnitude from 1 to 2, so that no
    norm or product over- or underflows.
    """
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    good = kept.where("vec_id is not null and label is not null and v is not null and size(v) > 0").where(ok)
    most = F.array_max(F.transform("v", F.abs))
    # In two factors, as a single one may lie beyond the range of doubles.
    shift = -F.floor(F.log2(most)).cast("double")
    one, two = F.pow(F.lit(2.0), F.floor(F.col("_s") / 2)), F.pow(F.lit(2.0), F.col("_s") - F.floor(F.col("_s") / 2))
    return good.withColumn("_s", shift).select("vec_id", "label", F.transform("v", lambda x: x * one * two).alias("v"))


def packed(good: DataFrame) -> DataFrame:
    """(vec_id, label, dim, same, v): vectors as bytes, in single precision where that holds them, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            values = part.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(part.column(3).to_numpy(zero_copy_only=False))
            rows = np.split(values, ends[:-1]) if len(ends) else []
            same = [hashlib.blake2b(x.tobytes(), digest_size=32).digest() for x in rows]
            with np.errstate(under="ignore"):
                v = [(short if (short := x.astype("<f4")).astype("<f8").tobytes() == x.tobytes() else x).tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(same, pa.binary()), pa.array(v, pa.binary())], ["vec_id", "label", "dim", "same", "v"])

    return good.select("vec_id", "label", "v", F.size("v").cast("long").alias("dim")).mapInArrow(run, "vec_id long, label string, dim long, same binary, v binary")


def _matrix(rows: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors of one length, in single precision if all are."""
    if all(len(x) == 4 * dim for x in rows):
        return np.frombuffer(b"".join(rows), "<f4").reshape(-1, dim)
    return np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8").astype(np.float64) for x in rows])


def _unit(given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and the norms."""
    rows = given.astype(np.float64)
    norms = np.linalg.norm(rows, axis=1)
    return rows / norms[:, None], norms


def axes(unit: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector, the principal axes of the unit vectors, the most spread first.

    Tasks send one sum of outer products for each length, so the driver gets squares of the dimension only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in slices(batches, 2048):
            sizes = part.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                rows, _ = _unit(_matrix(part.column(0).filter(pa.array(sizes == dim)).to_pylist(), dim))
                sums[dim] = sums.get(dim, 0) + rows.T @ rows
        for dim, total in sums.items():
            at = np.arange(dim * dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim * dim, dim)), pa.array(at), pa.array(total.ravel())], ["dim", "at", "x"])

    cells = unit.select("v", "dim").mapInArrow(run, "dim long, at long, x double")
    found: dict[int, np.ndarray] = {}
    for dim, at, x in cells.groupBy("dim", "at").agg(F.sum("x").alias("x")).collect():
        found.setdefault(dim, np.zeros(dim * dim))[at] = x
    return {dim: np.linalg.eigh(x.reshape(dim, dim))[1][:, ::-1].copy() for dim, x in found.items()}


def squares(unit: DataFrame, turned: dict[int, np.ndarray]) -> DataFrame:
    """Vectors dealt to the pairs of blocks of their label and length, sorted by pair, block and first axis.

    Each vector goes to as many tasks as its label has blocks.
    """
    spread = unit.sparkSession.sparkContext.broadcast(turned)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            lead = np.empty(part.num_rows)
            sizes = part.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                rows, _ = _unit(_matrix(part.column(3).filter(pa.array(sizes == dim)).to_pylist(), dim))
                lead[sizes == dim] = rows @ spread.value[dim][:, 0]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lead)], ["vec_id", "label", "dim", "v", "copies", "lead"])

    lead = unit.select("vec_id", "label", "dim", "v", "copies").mapInArrow(first, "vec_id long, label string, dim long, v binary, copies long, lead double")
    sizes = unit.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("v").cast("long")).alias("bytes"))
    side = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.when(F.col("n") > FULL, 2).otherwise(1)).cast("int")
    sizes = settle(sizes.select("label", "dim", side.alias("_side")))
    many = sizes.agg(F.coalesce(F.sum(F.col("_side") * (F.col("_side") + 1) / 2), F.lit(0))).first()[0]
    parts = max(1, min(16 * partitions(unit.sparkSession), 4 * int(many)))
    several = sizes.where("_side > 1")
    dealt = lead.join(F.broadcast(several) if several.count() * 3 <= BROADCAST_VALUES else several, ["label", "dim"], "left")
    own = F.pmod(F.xxhash64("vec_id"), F.coalesce("_side", F.lit(1))).cast("int")
    dealt = dealt.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_side", F.lit(1)) - 1)))
    pair = [F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), (F.col("_own") > F.col("_other")).alias("after")]
    dealt = dealt.select("label", "dim", *pair, "lead", "vec_id", "copies", "v")
    return dealt.repartition(parts, "label", "dim", "x", "y").sortWithinPartitions("label", "dim", "x", "y", "after", "lead", "vec_id")


def leading(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading coordinates and the norm of the others, in single precision."""
    k = max(1, 5 * turned.shape[1] // 16)
    rest = np.linalg.norm(turned[:, k:], axis=1)
    return np.column_stack([turned[:, :k], rest]).astype(np.float32)


def close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Index pairs whose product may reach the threshold: that of the leading coordinates plus that of the other norms."""
    may = a @ b.T >= threshold - SLACK
    return np.stack(np.nonzero(may)) if may.any() else np.empty((2, 0), np.int64)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Index pairs of rotated unit vectors whose product may reach the threshold."""
    return close(leading(a), leading(b), threshold)


class Links:
    """Groups of what is linked, each known by its smallest place."""

    def __init__(self):
        self.up = np.empty(0, np.int64)

    def add(self, n: int) -> int:
        """Room for n more; the place of the first."""
        at = len(self.up)
        self.up = np.concatenate((self.up, np.arange(at, at + n)))
        return at

    def roots(self, x: np.ndarray) -> np.ndarray:
        root = self.up[x]
        while (far := self.up[root] != root).any():
            root[far] = self.up[root[far]]
        self.up[x] = root
        return root

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.roots(i), self.roots(j)
            open_ = i != j
            i, j = i[open_], j[open_]
            np.minimum.at(self.up, np.maximum(i, j), np.minimum(i, j))


class Tile:
    """Vectors along the first axis: ids, how often each occurs, as given, leading coordinates."""

    def __init__(self, rows: list[tuple], dim: int, axis: np.ndarray, at: int):
        self.ids, self.weights = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.given = _matrix([r[2] for r in rows], dim)
        unit, self.norms = _unit(self.given)
        turned = unit @ axis
        self.low, self.high = turned[:, 0].min(), turned[:, 0].max()
        self.lead, self.more, self.at = leading(turned), np.zeros(len(rows), np.int64), at

    def apart(self, other: Tile, threshold: float) -> bool:
        """Along the first axis alone: product of the two coordinates nearest to each other, plus what the other axes may add."""
        one, two = (self.high, other.low) if self.high < other.low else (other.high, self.low)
        if one >= two:
            return False
        rest = lambda x: np.sqrt(max(0.0, 1 - x * x))
        return one * two + rest(one) * rest(two) < threshold - SLACK

    def meet(self, other: Tile, threshold: float, links: Links) -> None:
        if self.apart(other, threshold):
            return
        i, j = close(self.lead, other.lead, threshold)
        if self is other:
            i, j = i[i < j], j[i < j]
        yes = np.zeros(len(i), bool)
        for at in range(0, len(i), 65536):
            x, y = i[at : at + 65536], j[at : at + 65536]
            over = np.einsum("ij,ij->i", self.given[x].astype(np.float64), other.given[y].astype(np.float64))
            yes[at : at + 65536] = over / (self.norms[x] * other.norms[y]) >= threshold
        i, j = i[yes], j[yes]
        if len(i):
            np.add.at(self.more, i, other.weights[j])
            np.add.at(other.more, j, self.weights[i])
            links.link(i + self.at, j + other.at)


def compare(dealt: DataFrame, turned: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Rows (u, v, add) of ``squares``: with u = v, ``add`` more vectors linked to u; with u <> v, a link that connects."""
    made = "u long, v long, add long"
    spread = dealt.sparkSession.sparkContext.broadcast(turned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, after = None, False
        held: list[Tile] = []
        ids: list[np.ndarray] = []
        rows: list[tuple] = []
        links = Links()

        def told(u: np.ndarray, v: np.ndarray, add: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, add)], ["u", "v", "add"])

        def counted(tile: Tile) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(tile.more)
            if len(at):
                yield told(tile.ids[at], tile.ids[at], tile.more[at])

        def tile() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            now = Tile(rows, key[1], spread.value[key[1]], links.add(len(rows)))
            rows.clear()
            ids.append(now.ids)
            if after or key[2] == key[3]:
                for other in [*held, *([] if after else [now])]:
                    now.meet(other, threshold, links)
            if after:
                yield from counted(now)
            else:
                held.append(now)

        def over() -> Iterator[pa.RecordBatch]:
            nonlocal links
            yield from tile()
            for other in held:
                yield from counted(other)
            if ids:
                every = np.concatenate(ids)
                root = links.roots(np.arange(len(every)))
                at = np.flatnonzero(root != np.arange(len(every)))
                if len(at):
                    yield told(every[at], every[root[at]], np.zeros(len(at), np.int64))
            held.clear()
            ids.clear()
            links = Links()

        for part in slices(batches, 1024):
            for label, dim, x, y, later, *row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if key != (label, dim, x, y):
                    yield from over()
                    key, after = (label, dim, x, y), later
                elif after != later or len(rows) >= TILE:
                    yield from tile()
                    after = later
                rows.append(row)
        yield from over()

    return dealt.select("label", "dim", "x", "y", "after", "vec_id", "copies", "v").mapInArrow(run, made)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links between vectors of the same label with cosine >= threshold.

    Vectors that are null, empty, zero, or hold a null or non-finite component, and vectors without a
    label link with nothing, nor do vectors of different lengths.  Equal vectors of a label are compared
    once and counted as often as they occur.  Rows with a null id come back with a null component and
    kept null; rows that repeat an id count as one vector if equal.  An empty table gives an empty one;
    other columns are not read.
    """
    good = packed(usable(vectors, id_col, vector_col, label_col))
    classes = good.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"), F.count(F.lit(1)).alias("times"))
    classes = settle(classes)
    # Vectors that occur once go on as they are, so that only others are sent for their copies, if these are few.
    twice = classes.where("times > 1").select("label", "same", "rep", "copies")
    if twice.count() * len(twice.columns) <= BROADCAST_VALUES:
        marked = good.join(F.broadcast(twice), ["label", "same"], "left")
        one = marked.where("rep is null").withColumn("copies", F.lit(1).cast("long")).select("vec_id", "label", "dim", "v", "copies")
        others = marked.where("vec_id = rep")
    else:
        one, others = None, good.join(classes.withColumn("vec_id", F.col("rep")), ["vec_id", "label", "same"])
    others = others.dropDuplicates(["vec_id", "label", "same"]).select("vec_id", "label", "dim", "v", "copies")
    unit = settle(others if one is None else one.unionAll(others))
    turned = axes(unit)
    found = settle(compare(squares(unit, turned), turned, threshold))
    roots = components(found.where("u <> v").select("u", "v"))
    links = found.where("u = v").groupBy("u").agg(F.sum("add").alias("more"))
    classes = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(links.withColumnRenamed("u", "rep"), "rep", "left")
    final = settle(
        classes.select("label", "same", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    )
    of = good.select("vec_id", "label", "same").join(final, ["label", "same"]).select("vec_id", "root", "links")
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    out = every.join(of.dropDuplicates(["vec_id"]), "vec_id", "left")
    root = F.coalesce("root", "vec_id")
    return out.select(
        F.col("vec_id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        root.alias("component_id"),
        (F.col("vec_id") == root).alias("kept"),
    )
