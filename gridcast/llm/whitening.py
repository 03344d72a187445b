"""Whitening of vectors by an incremental eigendecomposition.

A spectrum holds a number of vectors, their mean, and eigenvalues and eigenvectors of their scatter.  A
further vector changes the scatter by one centred rank-one term; the new eigenvalues are the roots of a
secular equation between the old ones, and parts that the term leaves alone are deflated.  Partitions
build spectra, spectra join by one rank-one term for each direction and one for the distance of their
means, in rounds of bounded fan-in.  A last pass over the data projects it on the joint eigenvectors
and turns them by the small eigenproblem that is left (Rayleigh-Ritz), so what was rounded on the way
does not stay.

A block of vectors is folded to a triangular factor first, which has the same scatter in at most as
many rows as there are dimensions; each row then is one term.  Blocks of one vector are the plain update.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from gridcast.llm.store import partitions, settle, slices

SCALE, SHIFT = 64, 1_000_000
# Entries beyond this are held at it, so that whole numbers stay exact in doubles.
MOST = 1 << 51
# Rows of a block that is folded at once, and spectra that one task joins.
BLOCK, FAN = 4_096, 8
EPS = np.finfo(np.float64).eps
# Directions with less than this share of the largest eigenvalue hold no variance to speak of.
FLAT = 1e-13


def _roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots t of 1 + sum weights / (poles - t), as (nearest pole's index, distance from it); poles ascend, weights are above 0.

    Each root lies between two poles, the last one within the sum of weights behind the last.  Distances
    are bisected over the bits of doubles, so small ones are as exact as large ones.
    """
    size = len(poles)
    gaps = np.append(np.diff(poles), weights.sum())
    middle = poles + gaps / 2
    with np.errstate(divide="ignore"):
        half = 1 + (weights / (poles[None, :] - middle[:, None])).sum(1)
    # A negative value at the middle means that the root lies beyond it, nearer to the next pole.
    upper = (half < 0) & (np.arange(size) < size - 1)
    near = np.arange(size) + upper
    apart = poles[None, :] - poles[near][:, None]
    sign = np.where(upper, -1.0, 1.0)
    low = np.zeros(size, np.int64)
    high = np.where(np.arange(size) < size - 1, gaps / 2, gaps * (1 + 4 * EPS)).view(np.int64)
    for _ in range(64):
        mid = low + (high - low) // 2
        distance = mid.view(np.float64)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            value = 1 + (weights / (apart - (sign * distance)[:, None])).sum(1)
        # The sum rises from pole to pole: below zero the root lies to the right.
        right = np.where(upper, value > 0, value < 0) | (mid == 0)
        low, high = np.where(right, mid, low), np.where(right, high, mid)
        if ((high - low) <= 1).all():
            break
    return near, sign * high.view(np.float64)


class Spectrum:
    """Number, mean, eigenvalues (ascending) and eigenvectors (columns) of the scatter of vectors."""

    def __init__(self, size: int):
        self.n = 0
        self.mean = np.zeros(size)
        self.values = np.zeros(size)
        self.vectors = np.eye(size)

    def term(self, weight: float, vector: np.ndarray) -> None:
        """Adds weight * vector vectorᵀ to the scatter."""
        length = float(np.linalg.norm(vector))
        if not weight > 0 or not length > 0:
            return
        share = self.vectors.T @ (vector / length)
        weight *= length * length
        values, vectors = self.values, self.vectors
        tolerance = 8 * EPS * max(float(values[-1]), weight)
        # Equal eigenvalues: a reflection turns all of the term's part there into one direction.
        begins = np.flatnonzero(np.concatenate(([True], np.diff(values) > tolerance)))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(values)], strict=True):
            part = share[begin:end]
            if end - begin > 1 and np.any(part[:-1]):
                mirror = part.copy()
                mirror[-1] += np.copysign(np.linalg.norm(part), part[-1])
                mirror /= np.linalg.norm(mirror)
                vectors[:, begin:end] -= 2 * np.outer(vectors[:, begin:end] @ mirror, mirror)
                total = -np.copysign(np.linalg.norm(part), part[-1])
                share[begin:end] = 0
                share[end - 1] = total
        moved = np.flatnonzero(weight * np.abs(share) > tolerance)
        if not len(moved):
            return
        poles, part = values[moved], share[moved]
        near, distance = _roots(poles, weight * part * part)
        # poles[j] - root[i], from the nearest pole, so that nothing cancels.
        apart = (poles[None, :] - poles[near][:, None]) - distance[:, None]
        # The part that has exactly these roots: its vectors are at right angles.
        between = poles[:, None] - poles[None, :]
        np.fill_diagonal(between, 1.0)
        ratio = np.prod(-apart / between, axis=0)
        exact = np.sqrt(np.maximum(ratio, 0)) * np.sign(part)
        with np.errstate(divide="ignore", invalid="ignore"):
            turned = exact[None, :] / apart
        turned /= np.linalg.norm(turned, axis=1, keepdims=True)
        values[moved] = poles[near] + distance
        vectors[:, moved] = vectors[:, moved] @ turned.T
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def block(self, rows: np.ndarray) -> None:
        """Adds vectors: the terms of their folded, centred block, and one for the distance of the means."""
        count = len(rows)
        mean = rows.mean(0)
        if count > 1:
            for row in np.linalg.qr(rows - mean, mode="r"):
                self.term(1.0, row)
        self._shift(count, mean)

    def join(self, other: Spectrum) -> None:
        """Adds the vectors of another spectrum, one term for each of its directions."""
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.term(float(value), vector)
        self._shift(other.n, other.mean)

    def _shift(self, count: int, mean: np.ndarray) -> None:
        apart = mean - self.mean
        total = self.n + count
        self.term(self.n * count / total, apart)
        self.mean = self.mean + apart * (count / total)
        self.n = total

    def pack(self) -> bytes:
        return np.concatenate(([self.n], self.mean, self.values, self.vectors.ravel())).tobytes()

    @classmethod
    def unpack(cls, data: bytes, size: int) -> Spectrum:
        flat = np.frombuffer(data, np.float64)
        made = cls(size)
        made.n, made.mean = int(flat[0]), flat[1 : size + 1].copy()
        made.values, made.vectors = flat[size + 1 : 2 * size + 1].copy(), flat[2 * size + 1 :].reshape(size, size).copy()
        return made


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(64 c) of each entry, without the million that all of them get: it drops out of every difference."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def _packed(rows: np.ndarray) -> list[bytes]:
    """Whole numbers in the fewest bytes that hold all of a row; the first byte tells how many."""
    out: list[bytes] = [b""] * len(rows)
    most = np.maximum(rows.max(1), -1 - rows.min(1)) if rows.shape[1] else np.zeros(len(rows), np.int64)
    for width in (1, 2, 4, 8):
        fits = most < 1 << (8 * width - 1)
        if width > 1:
            fits &= most >= 1 << (4 * width - 1)
        at = np.flatnonzero(fits)
        data = rows[at].astype(f"<i{width}").tobytes()
        step = width * rows.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = bytes([width]) + data[k * step : (k + 1) * step]
    return out


def _unpacked(keys: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(keys), size), np.int64)
    for i, key in enumerate(keys):
        out[i] = np.frombuffer(key, f"<i{key[0]}", offset=1)
    return out


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers) of the good vectors of a batch, those of one length at a time."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        rows = numbers[begins[at][:, None] + np.arange(size)[None, :]]
        good = np.isfinite(rows).all(1)
        if good.any():
            yield at[good], whole_numbers(rows[good])


def distinct_vectors(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(size, key binary) of each distinct vector of whole numbers; a few bytes for each entry are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2_048):
            for _, rows in _by_size(part.column(0)):
                keys = list(dict.fromkeys(_packed(rows)))
                yield pa.RecordBatch.from_arrays([pa.array([rows.shape[1]] * len(keys), pa.int32()), pa.array(keys, pa.binary())], ["size", "key"])

    kept = vectors.select(F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return kept.mapInArrow(run, "size int, key binary").distinct()


def _sums(held: dict[int, list]) -> pa.RecordBatch:
    rows = [(size, n, [str(int(h) * (1 << 26) + int(w)) for h, w in zip(high, low, strict=True)], made.pack()) for size, (n, high, low, made) in held.items()]
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["size", "n", "sums", "state"])


def spectra(fit: DataFrame, block: int = BLOCK) -> dict[int, tuple[int, list[int], Spectrum]]:
    """For each length of vectors: their number, exact sums, and their joint spectrum.

    One state of dimensions² doubles leaves each task; FAN of them meet in a task, round by round, and
    one of each length comes to the driver.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def fold(size: int) -> None:
            held[size][3].block(np.concatenate(waiting.pop(size)).astype(np.float64))

        for part in slices(batches, 2_048):
            sizes = np.asarray(part.column(0))
            for size in np.unique(sizes).tolist():
                rows = _unpacked(part.column(1).filter(pa.array(sizes == size)).to_pylist(), size)
                state = held.setdefault(size, [0, np.zeros(size, np.int64), np.zeros(size, np.int64), Spectrum(size)])
                state[0] += len(rows)
                state[1] += (rows >> 26).sum(0)
                state[2] += (rows & ((1 << 26) - 1)).sum(0)
                for begin in range(0, len(rows), block):
                    waiting.setdefault(size, []).append(rows[begin : begin + block])
                    if sum(map(len, waiting[size])) >= block:
                        fold(size)
        for size in list(waiting):
            fold(size)
        if held:
            yield _sums(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for part in slices(batches, 1):
            size, n, sums, state = (c.to_pylist()[0] for c in part.columns)
            made = Spectrum.unpack(state, size)
            if size not in held:
                held[size] = [n, [int(s) for s in sums], made]
            else:
                mine = held[size]
                mine[0] += n
                mine[1] = [a + int(b) for a, b in zip(mine[1], sums, strict=True)]
                mine[2].join(made)
        rows = [(size, n, list(map(str, sums)), made.pack()) for size, (n, sums, made) in held.items()]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["size", "n", "sums", "state"])

    made = "size int, n long, sums array<string>, state binary"
    states = settle(fit.mapInArrow(build, made))
    tasks = partitions(fit.sparkSession)
    while states.groupBy("size").count().where("count > 1").limit(1).count():
        tasks = max(1, min(-(-tasks // FAN), -(-states.count() // FAN)))
        states = settle(states.repartition(tasks).mapInArrow(meet, made))
    return {r.size: (r.n, [int(s) for s in r.sums], Spectrum.unpack(bytes(r.state), r.size)) for r in states.collect()}


def _gram(fit: DataFrame, project: dict[int, Callable[[np.ndarray], np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums, and sums of products, of the projected vectors, for each length; a matrix for each task, added up in a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in slices(batches, 2_048):
            sizes = np.asarray(part.column(0))
            for size in np.unique(sizes).tolist():
                rows = _unpacked(part.column(1).filter(pa.array(sizes == size)).to_pylist(), size)
                flat = project[size](rows)
                flat = np.concatenate((np.ones((len(flat), 1)), flat), 1)
                held[size] = held.get(size, 0) + flat.T @ flat
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.tobytes() for m in held.values()], pa.binary())], ["size", "state"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in slices(batches, 1):
            size = part.column(0)[0].as_py()
            held[size] = held.get(size, 0) + np.frombuffer(part.column(1)[0].as_py(), np.float64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.tobytes() for m in held.values()], pa.binary())], ["size", "state"])

    made = "size int, state binary"
    states = settle(fit.mapInArrow(run, made))
    while states.groupBy("size").count().where("count > 1").limit(1).count():
        states = settle(states.repartition(-(-states.count() // (4 * FAN))).mapInArrow(add, made))
    out = {}
    for r in states.collect():
        flat = np.frombuffer(bytes(r.state), np.float64)
        width = round(len(flat) ** 0.5)
        square = flat.reshape(width, width)
        out[r.size] = (square[0, 1:], square[1:, 1:])
    return out


class Whitening:
    """Per length of vectors: n, sums, axes (columns), their eigenvalues and explained shares, and the largest identity error."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        # Sums over n, in two parts, so that differences with whole numbers lose nothing.
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])
        self.axes = np.empty((len(sums), 0))
        self.values = self.explained = np.empty(0)
        self.error = 0.0

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.whole).astype(np.float64) - self.rest

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return (self.centred(rows) @ self.axes) / np.sqrt(self.values)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)², exact; None beyond the range of a long."""
        apart = [[self.n * w - s for w, s in zip(self.whole.tolist(), self.sums, strict=True)]]
        most = int(np.abs(rows - self.whole).max(initial=0)) * self.n + max(map(abs, apart[0]), default=0)
        if most * most * max(1, rows.shape[1]) < 1 << 62:
            away = (rows - self.whole) * self.n + np.array(apart, np.int64)
            return (away * away).sum(1).tolist()
        out = []
        for row in rows.tolist():
            total = sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums, strict=True))
            out.append(total if total < 1 << 63 else None)
        return out


def learn(vectors: DataFrame, vec_col: str = "embedding", components: int = 16, block: int = BLOCK) -> dict[int, Whitening]:
    """The whitening of distinct vectors, by their length.

    Null vectors, vectors without entries and those with null or non-finite entries are left out; entries
    beyond 2^51 / 64 are held there.  Vectors of each length are whitened on their own.  Directions
    without variance are left out, as nothing can be whitened there.  Repeated rows count once, ids and
    other columns are not read.  An empty table gives an empty result.  A state holds dimensions² doubles:
    32 KB for 64 dimensions, 128 MB for 4,096; the driver holds one for each length.
    """
    fit = settle(distinct_vectors(vectors, vec_col))
    models: dict[int, Whitening] = {}
    start: dict[int, np.ndarray] = {}
    for size, (n, sums, made) in spectra(fit, block).items():
        models[size] = Whitening(n, sums)
        start[size] = made.vectors
    if not models:
        return models
    turned = _gram(fit, {k: (lambda rows, m=m, u=start[k]: m.centred(rows) @ u) for k, m in models.items()})
    for size, (total, products) in turned.items():
        m = models[size]
        # The eigenvectors met so far may lean a little: their own products are part of the small problem.
        basis, upper = np.linalg.qr(start[size])
        back = np.linalg.inv(upper)
        covariance = back.T @ (products / m.n - np.outer(total, total) / m.n / m.n) @ back
        values, small = np.linalg.eigh((covariance + covariance.T) / 2)
        trace = float(values.sum())
        order = np.argsort(-values, kind="stable")
        order = order[values[order] > FLAT * max(float(values.max(initial=0)), 0)][:components]
        m.values, m.axes = values[order], basis @ small[:, order]
        m.explained = m.values / trace if trace > 0 else m.values
    for size, (total, products) in _gram(fit, {k: m.whitened for k, m in models.items()}).items():
        m = models[size]
        away = products / m.n - np.outer(total, total) / m.n / m.n - np.eye(len(m.values))
        m.error = float(np.abs(away).max(initial=0))
    return models


def whiten(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every good row, a row for each component.

    Bad vectors (see ``learn``) and vectors of lengths that the models lack give no row, rows with a null
    id give rows with a null id, repeated rows give their rows each.  deviation is null beyond the range of
    a long.  Columns keep the type of the id; others are not read.
    """
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1_024):
            for at, rows in _by_size(part.column(1)):
                m = models.get(rows.shape[1])
                k = len(m.values) if m else 0
                if not k:
                    continue
                deviation = [d for d in m.deviations(rows) for _ in range(k)]
                columns = (np.tile(np.arange(1, k + 1), len(at)), np.full(k * len(at), m.n), deviation, m.whitened(rows).ravel(), np.tile(m.explained, len(at)), np.full(k * len(at), m.error))
                ids = part.column(0).take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["id", *names])

    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    schema = kept.select("id").schema.add("component", IntegerType())
    for name, kind in zip(names[1:], ("long", "long", "double", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)
