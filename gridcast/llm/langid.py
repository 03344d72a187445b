"""Language of texts by interpolated Kneser-Ney models of characters.

Texts are lower-cased letters with one boundary between words; letters are folded into 64 symbols, so a
run of four is a number below 2 ** 24 and a model of any corpus has a bounded size.  Counts are taken
over all training texts by Spark.  Each order is one sorted array of keys with a row of log
probabilities for every language, backed off already, so that a lookup serves all languages at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import settle, slices

ORDER, BITS = 4, 6
MASK = (1 << BITS * (ORDER - 1)) - 1
UNKNOWN = "und"
DISCOUNT = 0.75
# Rows that the calibration of scores reads at most, the first by hash of the id.
SAMPLE_ROWS = 3_000
HELD = 2_000_000


def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 no letter, 1-26 the letters a-z, 27-63 other letters by remainder."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = code - 96 if 97 <= code <= 122 else 27 + code % 37
    return table


_table: list[np.ndarray] = []


def grams(text: str | None) -> np.ndarray:
    """Keys of all runs of ORDER symbols, one for each letter and for the boundary after each word."""
    if not _table:
        _table.append(_symbols())
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    symbols = _table[0][codes]
    keep = symbols > 0
    if not keep.any():
        return np.empty(0, np.int64)
    symbols = symbols[keep | np.concatenate(([False], keep[:-1]))]
    padded = np.concatenate((np.zeros(ORDER - 1, np.int64), symbols.astype(np.int64)))
    keys = np.zeros(len(symbols), np.int64)
    for i in range(ORDER):
        keys = keys << BITS | padded[i : i + len(symbols)]
    return keys


def held_out(id_col: str = "doc_id") -> Column:
    """One fold of three, by checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, key, n) over all rows of ``docs``; tasks add up what they see before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def settle_held() -> None:
            for lang, parts in held.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    keys, at = np.unique(np.concatenate((sums[lang][0], keys)), return_inverse=True)
                    counts = np.bincount(at, np.concatenate((sums[lang][1], counts))).astype(np.int64)
                sums[lang] = (keys, counts)
            held.clear()

        for part in slices(batches):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = grams(text)
                if len(found):
                    held.setdefault(lang, []).append(found.astype(np.int32))
                    size += len(found)
            if size > HELD:
                settle_held()
                size = 0
        settle_held()
        for lang, (keys, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int32()), pa.array(counts, pa.int64())], ["lang", "key", "n"])

    kept = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    return kept.mapInArrow(run, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # by order from 1
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)  # by order from 2
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None  # log probability of a symbol that no text had
    line: tuple[float, float, float] = (0.0, 1.0, 0.0)

    def entropies(self, found: np.ndarray) -> np.ndarray:
        """Cross-entropy per symbol of a text in each language."""
        total = np.zeros(len(self.langs))
        keys = found
        for order in range(ORDER, 0, -1):
            table = self.keys[order - 1]
            at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            hit = table[at] == keys
            total += self.logp[order - 1][at[hit]].sum(0, dtype=np.float64)
            keys = keys[~hit]
            if order == 1 or not len(keys):
                break
            context = keys >> BITS
            table = self.contexts[order - 2]
            at = np.minimum(np.searchsorted(table, context), len(table) - 1)
            hit = table[at] == context
            total += self.backoff[order - 2][at[hit]].sum(0, dtype=np.float64)
            keys = keys & ((1 << BITS * (order - 1)) - 1)
        if len(keys):
            total += len(keys) * self.floor
        return -total / max(1, len(found))

    def features(self, found: np.ndarray) -> tuple[int, float, float]:
        """Best language, its lead over the second, and how many symbols say so."""
        h = self.entropies(found)
        order = np.argsort(h, kind="stable")
        lead = float(h[order[1]] - h[order[0]]) if len(order) > 1 else 1.0
        return int(order[0]), lead, float(np.log(len(found)))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0
        best, lead, size = self.features(found)
        a, b, c = self.line
        return self.langs[best], float(1 / (1 + np.exp(-np.clip(a + b * min(lead * 10, 20) + c * size, -30, 30))))


def build(counts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model of (language, sorted keys, counts) of the highest order; lower orders count distinct contexts."""
    model = Model([lang for lang, _, _ in counts])
    if not counts:
        return model
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for _, keys, n in counts:
        for order in range(ORDER, 0, -1):
            by_order[order - 1].append((keys, n.astype(np.float64)))
            keys, n = np.unique(keys & ((1 << BITS * (order - 1)) - 1), return_counts=True)
    floor = model.floor = np.zeros(len(counts))
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k for k, _ in by_order[order - 1]]))
        p = np.zeros((len(union), len(counts)))
        if order == 1:
            for l, (keys, n) in enumerate(by_order[0]):
                # The first order is mixed with equal shares of all symbols.
                total = n.sum()
                p[:, l] = DISCOUNT * len(keys) / total / 64
                floor[l] = np.log(DISCOUNT * len(keys) / total / 64)
                p[np.searchsorted(union, keys), l] += np.maximum(n - DISCOUNT, 0) / total
        else:
            context = union >> BITS
            below = model.keys[order - 2]
            # Every suffix of a key of this order is a key of the order below.
            lower = np.exp(model.logp[order - 2])[np.searchsorted(below, union & ((1 << BITS * (order - 1)) - 1))]
            heads = np.unique(context)
            weight = np.ones((len(heads), len(counts)))
            for l, (keys, n) in enumerate(by_order[order - 1]):
                where = np.searchsorted(heads, keys >> BITS)
                total, kinds = np.bincount(where, n, len(heads)), np.bincount(where, minlength=len(heads))
                weight[:, l] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                at = np.searchsorted(union, keys)
                p[at, l] = np.maximum(n - DISCOUNT, 0) / total[where]
            p += weight[np.searchsorted(heads, context)] * lower
            model.contexts.append(heads)
            model.backoff.append(np.log(weight).astype(np.float32))
        model.keys.append(union)
        model.logp.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
    return model


def _calibrate(points: np.ndarray, right: np.ndarray) -> tuple[float, float, float]:
    """Logistic line from (lead, log size) to the chance of being right; starts from a plain rule and is held near it."""
    line = prior = np.array([-1.0, 2.0, 0.5])
    x = np.column_stack((np.ones(len(points)), np.minimum(points[:, 0] * 10, 20), points[:, 1])) if len(points) else np.zeros((0, 3))

    def loss(at: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(right > 0, -1, 1) * (x @ at)).sum() + ((at - prior) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (p - right) + (line - prior))
        size = 1.0
        while size > 1e-6 and loss(line - size * step) > loss(line):
            size /= 2
        line = line - size * step
    return tuple(float(v) for v in line)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows that are not held out and have a language; scores are calibrated on a bounded sample of them.

    Rows without text or language are left out, repeated rows count each, texts may be of any length, other columns
    are not read.  An empty table gives a model without languages, by which every text is ``und``.
    """
    train = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    table = settle(gram_counts(train, text_col, lang_col)).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    lang, key, n = np.array(table.column("lang").to_pylist(), object), table.column("key").to_numpy(), table.column("n").to_numpy()
    counts = []
    for name in langs:
        mine = lang == name
        order = np.argsort(key[mine], kind="stable")
        counts.append((name, key[mine][order].astype(np.int64), n[mine][order]))
    model = build(counts)
    if langs:
        ids = train.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
        sample = train.join(F.broadcast(ids.distinct()), F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
        spread = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows = [(g, t) for g, t in zip(map(grams, part.column(0).to_pylist()), part.column(1).to_pylist(), strict=True) if len(g)]
                # Short cuts of the texts too, as the scores of whole ones leave nothing to learn.
                made = [(*spread.value.features(g[:size]), t) for g, t in rows for size in (4, 16, len(g))]
                columns = [[lead for _, lead, _, _ in made], [size for _, _, size, _ in made], [float(langs[b] == t) for b, _, _, t in made]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], ["lead", "size", "ok"])

        got = sample.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(run, "lead double, size double, ok double").toArrow()
        got = got.sort_by([("lead", "ascending"), ("size", "ascending"), ("ok", "ascending")])
        model.line = _calibrate(np.column_stack([got.column("lead").to_numpy(), got.column("size").to_numpy()]), got.column("ok").to_numpy())
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.5) -> DataFrame:
    """(id, lang_pred, score, accepted): the language of least cross-entropy per symbol, and how likely that is right.

    ``und`` with score 0 if a text is null or empty or has no letter, or if nothing was learned; ``accepted``
    is false there and where the score is under ``reject_below``.  Of equal cross-entropies the language
    that comes first counts.  Rows are mapped one by one: null ids, repeated rows, other columns and empty
    tables need no care, and texts may be of any length.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [spread.value.predict(t) for t in part.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            columns.append(pa.array([f[0] != UNKNOWN and f[1] >= reject_below for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "lang_pred", "score", "accepted"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return kept.mapInArrow(run, "id long, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)
