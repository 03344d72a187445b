"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(bias + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)): pairwise interactions
of rank RANK, in time linear in the number of features of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import slices
from gridcast.llm.words import WordHashes

SLOTS, RANK = 1 << 14, 8
# Labelled rows that a model is fitted on at most, the first by hash of the id.
TRAIN_ROWS = 8_000
STATS = 18  # structure statistics of a text
LENGTH = 24  # one-hot powers of two of the length given as metadata
WIDTH = SLOTS + STATS + LENGTH
# Kinds of bytes; 0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line break, 6 sentence mark, 7 other mark, 8 beyond ASCII.
KINDS = np.array(
    [8 if b > 127 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in (9, 32) else 5 if b == 10 else 6 if b in b".,;:?'" else 7 if 33 <= b <= 126 else 0 for b in range(256)],
    np.uint8,
)


def features(text: bytes | None, length: int | None, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): words by damped counts of norm 1, statistics, and the length class of the metadata."""
    text = text or b""
    kinds = np.bincount(KINDS[np.frombuffer(text, np.uint8)], minlength=9) if text else np.zeros(9, int)
    words = text.lower().split()
    n, size = len(words), max(1, len(text))
    hashes = np.array([memo[w] for w in words], np.uint64)
    slots, counts = np.unique((hashes >> np.uint64(40)).astype(np.int64) % SLOTS, return_counts=True)
    values = np.log1p(counts)
    values = values / max(1e-9, np.sqrt((values**2).sum()))
    again = float(np.count_nonzero(hashes[1:] == hashes[:-1])) / max(1, n)
    lines = text.split(b"\n")
    stats = np.zeros(STATS)
    stats[:9] = kinds / size
    stats[9] = again
    stats[10] = len(np.unique(hashes)) / max(1, n)
    stats[11] = np.log1p(n) / 10
    stats[12] = min(1.0, size / max(1, n) / 20)
    stats[13] = len(set(lines)) / len(lines)
    stats[14] = np.log1p(len(lines)) / 10
    stats[15] = kinds[2] / max(1, kinds[1] + kinds[2] + kinds[8])
    stats[16] = min(1.0, kinds[7] / max(1, n))
    stats[17] = 1.0 if not n else 0.0
    index = [slots, np.arange(SLOTS, SLOTS + STATS)]
    value = [values, stats]
    if length is not None and length >= 0:
        index.append(np.array([SLOTS + STATS + min(LENGTH - 1, int(length).bit_length())]))
        value.append(np.array([0.5]))
    return np.concatenate(index), np.concatenate(value)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        inner = self.factors[index] * value[:, None]
        total = inner.sum(0)
        return self.bias + float(self.weights[index] @ value) + 0.5 * float((total**2).sum() - (inner**2).sum())

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, value), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss by adaptive gradient steps over batches of rows in seeded order; without rows, all scores are 1/2."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK)))
    if not rows:
        machine.factors[:] = 0
        return machine
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    machine.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            index = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch])
            starts = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in batch])[:-1]))
            row = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            inner = machine.factors[index] * value[:, None]
            total = np.add.reduceat(inner, starts)
            margin = machine.bias + np.add.reduceat(machine.weights[index] * value, starts)
            margin += 0.5 * ((total**2).sum(1) - np.add.reduceat((inner**2).sum(1), starts))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) / len(batch)
            pull = slope[row] * value
            step_b = float(slope.sum())
            step_w = np.bincount(index, pull, WIDTH) + decay * machine.weights / len(rows)
            part = pull[:, None] * (total[row] - inner)
            step_v = np.stack([np.bincount(index, part[:, f], WIDTH) for f in range(RANK)], 1) + decay * machine.factors / len(rows)
            seen_b, seen_w, seen_v = seen_b + step_b**2, seen_w + step_w**2, seen_v + step_v**2
            machine.bias -= rate * step_b / np.sqrt(seen_b)
            machine.weights -= rate * step_w / np.sqrt(seen_w)
            machine.factors -= 0.3 * rate * step_v / np.sqrt(seen_v)
    return machine


def held_out(id_col: str = "doc_id") -> Column:
    """One fold of five, by checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", length_col: str | None = "n_chars", rows: int = TRAIN_ROWS
) -> Machine:
    """Fits on at most ``rows`` labelled documents that are not held out.

    Rows without id or label are left out; of several labels of one id the largest counts, and of several
    texts the first by order.  Null texts are learnt as empty ones, texts may be of any length, other columns are
    not read; without labelled documents, empty tables included, every score is that of an unfitted machine.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_t"), _length(docs, length_col).alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in slices(batches):
            made = [features(t, n, memo) for t, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            index, value = [m[0].astype("<i4").tobytes() for m in made], [m[1].astype("<f4").tobytes() for m in made]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["id", "y", "i", "v"])

    joined = texts.join(F.broadcast(marked), "_id").select("_id", "_y", "_t", "_n")
    # A bounded sample: at most ``rows`` documents come to the driver, as feature vectors.
    got = joined.mapInArrow(run, "id long, y double, i binary, v binary").toArrow().sort_by([("id", "ascending"), ("i", "ascending")])
    first = {i: at for at, i in reversed(list(enumerate(got.column("id").to_pylist())))}
    at = sorted(first.values())
    index, value = got.column("i").to_pylist(), got.column("v").to_pylist()
    pairs = [(np.frombuffer(index[k], "<i4").astype(np.int64), np.frombuffer(value[k], "<f4").astype(np.float64)) for k in at]
    return fit(pairs, np.array(got.column("y").to_pylist(), np.float64)[at])


def _length(docs: DataFrame, length_col: str | None) -> Column:
    return F.col(length_col).cast("long") if length_col and length_col in docs.columns else F.lit(None).cast("long")


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row; null and empty texts are scored by their statistics alone.

    Rows are mapped one by one: nulls in other columns, repeated rows, ties and clashing names make no
    difference, texts may be of any length, and an empty table gives an empty one.
    """
    spread = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in slices(batches):
            texts, sizes = part.column(1).to_pylist(), part.column(2).to_pylist()
            found = [spread.value.score(*features(t, n, memo)) for t, n in zip(texts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], ["id", "score", "predicted"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"), _length(docs, length_col).alias("n"))
    return kept.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with the columns they have, in one pass.

    A null text is scored as an empty one, a null length as the text's own; texts may be of any length.  Rows are
    judged one by one, so ids, repeats, ties and other columns make no difference; an empty table gives an empty one.
    """
    spread = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col and length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in slices(batches):
            texts = [t.encode() if t else b"" for t in part.column(at).cast(pa.string()).to_pylist()]
            sizes = [None] * len(texts) if size is None else part.column(size).to_pylist()
            keep = [spread.value.score(*features(t, n, memo)) >= threshold for t, n in zip(texts, sizes, strict=True)]
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
