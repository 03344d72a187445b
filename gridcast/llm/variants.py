"""Spelling variants: words one edit apart, found by dense tiles of common prefix and suffix lengths.

Two words are one edit apart exactly if their common prefix and suffix together reach the longer
length less one.  Words meet in blocks: an edit that lies in a window of the longer word leaves what
is before and behind the window alike, so both words share that part.  Each length starts with two
windows; a block of too many words is cut again at half of each window, down to windows of one place,
where a block holds one word for each letter at most.  So no block grows with the data.  Within a
block, tiles of padded code-point matrices are compared pair by pair; counts and the best neighbour
of each word leave the task, never the pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import settle, slices, small_side

LETTERS = re.compile("[a-zÀ-ÿ]+")
# Letters that a place may hold: blocks of one place hold so many words and one more at most.
ALPHABET = 26 + 64
# Blocks of more words are cut again; tiles have so many rows.
BLOCK, TILE = 1_024, 256
# Counts of words that a task holds before it gives them out.
HELD = 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, damage: int = 0) -> DataFrame:
    """(word, n) of the runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased, of at least ``least_chars`` code points.

    ``damage``: where it divides h, the unsigned crc32 of ``<id>:<run>``, the run loses its code point
    h % length (0 turns this off).  A null text has no words, a null id counts as an empty one.  Texts may
    be of any length; repeated rows count each; other columns are not read; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for part in slices(batches):
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found = Counter(LETTERS.findall(text.encode().lower().decode()))
                if damage:
                    start = crc32(f"{name}:".encode())
                    for word in [w for w in found if crc32(w.encode(), start) % damage == 0]:
                        n = found.pop(word)
                        at = crc32(word.encode(), start) % len(word)
                        # Damaged runs may meet a run of the same text.
                        held[word[:at] + word[at + 1 :]] += n if len(word) > least_chars else 0
                for word, n in found.items():
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    kept = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    made = kept.mapInArrow(run, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, longer, lo, hi) with the digest of what lies outside their window."""
    before = F.substring(F.col("word"), F.lit(1), F.col("lo"))
    behind = F.right(F.col("word"), F.col("longer") - F.col("hi"))
    return rows.select("word", "n", "longer", "lo", "hi", F.xxhash64(before, F.lit("|"), behind).alias("key"))


def _windows(words: DataFrame) -> DataFrame:
    """Each word as the longer or equal one of a pair and as the shorter one, with the edit in the first half or in the second."""
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer")
    rows = words.select("word", "n", longer).withColumn("mid", F.floor(F.col("longer") / 2).cast("int"))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("lo"), F.col("mid").alias("hi")), F.struct(F.col("mid").alias("lo"), F.col("longer").alias("hi"))))
    return _keyed(rows.select("word", "n", "longer", halves.alias("w")).select("word", "n", "longer", "w.lo", "w.hi"))


def near_tile(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], longer: int, lo: int, hi: int) -> np.ndarray:
    """Which pairs of two tiles are one edit apart, with the first place it may have in the window.

    A tile is code points from the left, from the right (both padded with 0), and lengths.
    """
    (ahead_a, back_a, size_a), (ahead_b, back_b, size_b) = left, right
    lengths = []
    for a, b in ((ahead_a, ahead_b), (back_a, back_b)):
        alike = np.ones((len(a), len(b)), bool)
        total = np.zeros((len(a), len(b)), np.int32)
        for j in range(longer):
            alike &= a[:, j, None] == b[None, :, j]
            if not alike.any():
                break
            total += alike
        lengths.append(total)
    prefix, suffix = lengths
    # Padding equals padding, so lengths are bounded by the shorter word.
    shorter = np.minimum(size_a[:, None], size_b[None, :])
    prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
    of_length = np.maximum(size_a[:, None], size_b[None, :]) == longer
    place = np.maximum(longer - 1 - suffix, 0)
    same = (prefix == longer) & (shorter == longer)
    return of_length & ~same & (prefix + suffix >= longer - 1) & (place >= lo) & (place < hi)


def _tile(words: list[str], longer: int) -> tuple[np.ndarray, ...]:
    ahead, back = np.zeros((2, len(words), longer), np.uint8)
    for i, w in enumerate(words):
        points = np.frombuffer(w.encode("latin-1"), np.uint8)
        ahead[i, : len(w)] = points
        back[i, longer - len(w) :] = points
    return ahead, back[:, ::-1], np.array([len(w) for w in words], np.int32)


def neighbours(words: list[str], counts: list[int], longer: int, lo: int, hi: int) -> list[tuple[str, int, int, str]]:
    """(word, number of near words, the largest n of them, that word) of a block, where there are any; ties go to the smallest word."""
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    words, counts = [words[i] for i in order], [counts[i] for i in order]
    tiles = [_tile(words[t : t + TILE], longer) for t in range(0, len(words), TILE)]
    total = np.zeros(len(words), np.int64)
    first = np.full(len(words), len(words), np.int64)
    for i, left in enumerate(tiles):
        for j in range(i, len(tiles)):
            near = near_tile(left, tiles[j], longer, lo, hi)
            for side, (rows, columns) in enumerate(((i, j), (j, i))[: 1 if i == j else 2]):
                found = near.T if side else near
                at = slice(rows * TILE, rows * TILE + len(found))
                total[at] += found.sum(1)
                first[at] = np.minimum(first[at], np.where(found.any(1), columns * TILE + found.argmax(1), len(words)))
    return [(words[k], int(total[k]), counts[first[k]], words[first[k]]) for k in np.flatnonzero(total).tolist()]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for the words of ``words`` (word, n) that differ from others by one edit.

    Words are distinct and made of a-z and U+00C0 to U+00FF.  best is the near word of largest n, the
    smallest of equal ones.  Without near words the result is empty.
    """
    rows = settle(_windows(words))
    parts: list[DataFrame] = []
    made = "word string, n_near long, best_n long, best string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[str, int]] = []
        at: tuple = ()
        found: list[tuple] = []

        def close() -> None:
            if len(block) > 1 and any(len(w) == at[0] for w, _ in block):
                found.extend(neighbours([w for w, _ in block], [n for _, n in block], *at[:3]))

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["word", "n_near", "best_n", "best"])

        for part in slices(batches, 4_096):
            for longer, lo, hi, key, word, n in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if at != (longer, lo, hi, key):
                    close()
                    block, at = [], (longer, lo, hi, key)
                block.append((word, n))
            if found:
                yield out()
                found.clear()
        close()
        if found:
            yield out()

    names = ["longer", "lo", "hi", "key"]
    while True:
        sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("m"), F.max(F.length("word") == F.col("longer")).alias("whole"))
        large = settle(sizes.where((F.col("m") > max(BLOCK, 2 * ALPHABET)) & F.col("whole")).select(*names))
        more = not large.isEmpty()
        ready = rows.join(small_side(large), names, "left_anti") if more else rows
        dealt = ready.repartition(*names).sortWithinPartitions(*names)
        parts.append(dealt.select(*names, "word", "n").mapInArrow(run, made))
        if not more:
            break
        cut = rows.join(small_side(large), names).withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
        halves = F.explode(F.array(F.struct("lo", F.col("mid").alias("hi")), F.struct(F.col("mid").alias("lo"), "hi")))
        rows = settle(_keyed(cut.select("word", "n", "longer", halves.alias("w")).select("word", "n", "longer", "w.lo", "w.hi")))
    together = parts[0]
    for other in parts[1:]:
        together = together.unionAll(other)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("top")
    found = together.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.word").alias("best"))


def group(counts: DataFrame, ratio: int = 5, least_n: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``counts`` (word, n) that occur ``least_n`` times or more.

    A word's form is its near word of largest n (ties: the smallest word) if that n is at least ``ratio``
    times its own, else null; root is where the forms lead in the end, the word itself without a form.
    Counts grow along forms, so they never lead in a circle (``ratio`` over 1), and a word has few steps
    to go: their number is bounded by the logarithm of the largest count.  Words with a null word or n are
    left out.  An empty table gives an empty one.
    """
    words = settle(counts.where("word is not null and n is not null").where(F.col("n") >= least_n).select("word", "n"))
    found = words.join(near_words(words), "word", "left")
    formed = F.col("best_n") >= F.col("n") * ratio
    rows = settle(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    step = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # Each round doubles the steps; no word is the form of more words than there are edits of it.
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            break
    return rows.join(step.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
