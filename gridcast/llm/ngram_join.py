"""Jaccard join of word-shingle sets by trees over count vectors.

Shingles are hashed into groups; a document is the point of its group counts.  The sum of the
smaller coordinates bounds the overlap of two sets, and of the upper corners of two boxes the
overlap of any two points in them.  Boxes over a whole corpus overlap in all coordinates and prune
nothing but sizes, so there is not one tree but a forest: one for each bucket of documents that share
one of the shingles that come first in hash order (two linked sets always do), then one for each
family of documents that such buckets connect.  Leaves hold a bounded number of documents sorted by
size; pairs of leaves, then pairs of points are dropped by the bound; the rest are counted exactly.

Equal sets are joined first.  A bucket is first tied together at its smallest member, and only
buckets whose members are then still apart are compared leaf by leaf, so groups of thousands of near
copies do not meet in each of the buckets they share.

Shingles that many documents have come last in that order, whatever their hash: they are counted first,
in a table of fixed size.  A line that a tenth of the corpus repeats would else be among the first
shingles of all these documents, and they would meet pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.graph import components
from gridcast.llm.store import partitions, settle, slices, small_side
from gridcast.llm.words import shingles, word_hashes

GROUPS = 64
# Groups are halved for sets of over so many shingles a group: of large sets any two fill groups alike.
EACH, MOST_GROUPS = 6, 1 << 16
# A leaf of a tree holds at most so many documents and bytes of shingles.
LEAF_ROWS, LEAF_BYTES = 128, 1024 * 1024
# Rows with whole sets that a worker takes at a time, as sets of long texts are large.
WHOLE_SETS = 16
# Buckets of at most so many documents give their pairs; larger ones are trees.
FEW = 16
# A tree of over so many leaves is dealt out in squares of leaf pairs, at most so many a side.
SQUARE, SQUARES = 32, 32
# Shingles are counted in so many slots, sent in blocks; those of a slot with over OFTEN, and over OFTEN_MEANS times the mean, are common.
SLOTS, BLOCK, OFTEN, OFTEN_MEANS = 1 << 22, 1 << 14, 64, 4


class Rule:
    """Linked if ``den`` * intersection >= ``num`` * union, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, both):
        """Least intersection of two sets whose sizes sum to ``both``."""
        return -(-self.num * both // (self.den + self.num))

    def prefix(self, size: int) -> int:
        """So many shingles, first in a common order, of which a linked set has at least one."""
        return size - -(-self.num * size // self.den) + 1


def _set_of(text: bytes | None, size: int) -> np.ndarray:
    return shingles(word_hashes(text), size)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def common(docs: DataFrame, rule: Rule, shingle: int, text_col: str) -> np.ndarray:
    """Which slots hold shingles that many documents have; of each, as many as twice the first by hash count.

    Any answer gives the same links: it sets the order of shingles only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.uint32)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                hashes = _set_of(text, shingle)
                if len(hashes):
                    np.add.at(table, _slots(hashes[: 2 * rule.prefix(len(hashes))]), 1)
        rows = []
        for block in range(SLOTS // BLOCK):
            own = table[block * BLOCK : (block + 1) * BLOCK]
            if (at := np.flatnonzero(own)).size:
                rows.append((block, int(own.sum()), at.astype("<u2").tobytes(), own[at].astype("<u4").tobytes()))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "total", "at", "times"])

    counted = settle(docs.select(F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(count, "block long, total long, at binary, times binary"))
    least = max(OFTEN, OFTEN_MEANS * (counted.agg(F.sum("total")).first()[0] or 0) / SLOTS)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in slices(batches):
            for block, at, times in zip(*[c.to_pylist() for c in part.columns], strict=True):
                sums.setdefault(block, np.zeros(BLOCK, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(times, "<u4")
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(total > least).tobytes()], pa.binary())], ["block", "bits"])

    dealt = counted.select("block", "at", "times").repartition(min(SLOTS // BLOCK, partitions(docs.sparkSession)), "block")
    found = np.zeros(SLOTS, bool)
    for block, bits in dealt.mapInArrow(over, "block long, bits binary").collect():
        found[block * BLOCK : (block + 1) * BLOCK] = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return found


def _first(hashes: np.ndarray, many: int, often: np.ndarray) -> np.ndarray:
    """The first of a set's shingles: by hash, common ones last."""
    last = often[_slots(hashes)]
    rare = hashes[~last][:many]
    return rare if len(rare) == many else np.concatenate((rare, hashes[last][: many - len(rare)]))


def _counts(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each group, a range of hash values; the bytes of a number come first."""
    bits = GROUPS.bit_length() - 1
    while len(hashes) > EACH << bits and 1 << bits < MOST_GROUPS:
        bits += 1
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    size = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _fine(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, f"<u{counts[0]}", offset=1)


def _points(fine: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    """Counts of all sets for the same groups, no more than any has."""
    out = np.empty((len(fine), groups), np.int32)
    for i, c in enumerate(fine):
        out[i] = c.reshape(groups, -1).sum(1)
    return out


def signatures(docs: DataFrame, rule: Rule, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, whole binary, counts binary, keys array): the digest of the set, its point, its first shingles."""
    spread = docs.sparkSession.sparkContext.broadcast(common(docs, rule, shingle, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, whole, counts, keys = [], [], [], []
            for text in part.column(1).to_pylist():
                hashes = _set_of(text, shingle)
                n = len(hashes)
                sizes.append(n)
                whole.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if n else None)
                counts.append(_counts(hashes) if n else None)
                keys.append(_first(hashes, rule.prefix(n), spread.value).view(np.int64) if n else np.empty(0, np.int64))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(counts, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "whole", "counts", "keys"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return kept.mapInArrow(run, "doc_id long, n long, whole binary, counts binary, keys array<long>")


def leaves(rows: DataFrame, rule: Rule) -> DataFrame:
    """Packs (tree, members, doc_id, n, mark, counts, body) into leaves: runs of one tree, sorted by size.

    A tree is dealt out by size class, and a large one by hash too, so that no task gets a whole one.  A
    leaf holds its members' sets as the distinct shingles of all, in order, and a bit for each member and
    shingle where that is shorter, as near copies share most of them; else the sets follow each other.
    """
    made = "tree long, leaf long, low long, high long, box array<int>, ids array<long>, marks array<long>, counts array<binary>, shingles binary, bits binary"
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []
        weight = 0

        def leaf() -> tuple:
            box = _points([_fine(r[4]) for r in held]).max(0)
            bodies = [r[5] for r in held]
            shingles_, bits = _packed([np.frombuffer(b, "<u8") for b in bodies])
            short = shingles_.nbytes + bits.nbytes < sum(map(len, bodies))
            sets = (shingles_.tobytes(), bits.tobytes()) if short else (b"".join(bodies), b"")
            return (held[0][0], held[0][1], held[0][2], held[-1][2], box, *([r[k] for r in held] for k in (1, 3, 4)), *sets)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [f.split()[0] for f in made.split(", ")])

        for part in slices(batches, WHOLE_SETS):
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue
                if held and (held[0][0] != row[0] or len(held) >= LEAF_ROWS or weight + len(row[5]) > LEAF_BYTES):
                    done.append(leaf())
                    held, weight = [], 0
                held.append(row)
                weight += len(row[5])
            if done:
                yield batch()
                done = []
        if held:
            done.append(leaf())
            yield batch()

    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(rule.den / rule.num)))
    salt = F.pmod(F.xxhash64("doc_id"), F.floor(F.col("members") / (32 * LEAF_ROWS)) + 1)
    dealt = rows.withColumn("_band", band).withColumn("_salt", salt).repartition("tree", "_band", "_salt")
    dealt = dealt.sortWithinPartitions("tree", "n", "doc_id").select("tree", "doc_id", "n", "mark", "counts", "body")
    return settle(dealt.mapInArrow(run, made))


def leaf_pairs(leaf: DataFrame, rule: Rule, marked: bool = False) -> DataFrame:
    """Pairs of leaves of one tree that may hold linked documents; with ``marked``, of which some differ in mark."""
    several = leaf.groupBy("tree").agg(F.count(F.lit(1)).alias("n_leaves")).where("n_leaves > 1")
    side = F.least(F.ceil(F.col("n_leaves") / SQUARE), F.lit(SQUARES)).cast("int")
    own = F.pmod(F.xxhash64("leaf"), F.col("_side")).cast("int")
    dealt = leaf.join(several, "tree").withColumn("_side", side).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_side") - 1)))
    dealt = dealt.withColumns({"least": F.array_min("marks"), "most": F.array_max("marks")})
    a, b = (dealt.select("tree", F.col(x).alias("_x"), F.col(y).alias("_y"), *[F.col(c).alias(f"{c}_{s}") for c in [*leaf.columns, "least", "most"] if c != "tree"]) for s, x, y in (("a", "_own", "_other"), ("b", "_other", "_own")))
    most = F.aggregate(F.zip_with("box_a", "box_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    apart = F.col("leaf_a") < F.col("leaf_b")
    close = F.col("low_b") * rule.num <= F.col("high_a") * rule.den
    near = F.col("low_a") * rule.num <= F.col("high_b") * rule.den
    # The sum of sizes is at least that of the lower ends, and so is the overlap it asks for.
    bound = most * (rule.den + rule.num) >= (F.col("low_a") + F.col("low_b")) * rule.num
    differ = F.least("least_a", "least_b") < F.greatest("most_a", "most_b") if marked else F.lit(True)
    return a.join(b, ["tree", "_x", "_y"]).where(apart & close & near & differ & bound)


def _survivors(a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """Which pairs of points the summed coordinate minima leave, and all the overlaps they may have."""
    most = np.empty((len(a), len(b)), np.int32)
    for i in range(len(a)):
        most[i] = np.minimum(a[i], b).sum(1)
    both = a.sum(1)[:, None] + b.sum(1)[None, :]
    return most >= rule.overlap(both.astype(np.int64))


# Counts that are compared at a time.
CELLS = 1 << 20


def _still(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) are left with as many groups as both sets have."""
    groups = np.minimum(np.array([len(x) for x in a])[i], np.array([len(x) for x in b])[j])
    ok = np.ones(len(i), bool)
    for many in np.unique(groups[groups > GROUPS]).tolist():
        own = np.flatnonzero(groups == many)
        (left, x), (right, y) = (np.unique(k[own], return_inverse=True) for k in (i, j))
        points, others = _points([a[k] for k in left], many), _points([b[k] for k in right], many)
        size, other = points.sum(1, dtype=np.int64), others.sum(1, dtype=np.int64)
        step = max(1, CELLS // many)
        for at in range(0, len(own), step):
            k, m = x[at : at + step], y[at : at + step]
            ok[own[at : at + step]] = np.minimum(points[k], others[m]).sum(1) >= rule.overlap(size[k] + other[m])
    return ok


def _forest(n: int, pairs: Iterator[tuple[int, int]] | list) -> list[tuple[int, int]]:
    """The pairs that connect what was not connected before them."""
    up = list(range(n))
    kept = []
    for i, j in pairs:
        x, y = i, j
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


def _packed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of several sorted sets, and for each set its row of bits over them."""
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.zeros((len(sets), len(every)), bool)
    member[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = True
    return every, np.packbits(member, axis=1)


# Ids, marks, points, shingles, bits and finer counts of a leaf.
Leaf = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]
Compare = Callable[[Leaf, Leaf, bool], tuple[list, ...]]


def walk(leaf: DataFrame, rule: Rule, compare: Compare, made: str, marked: bool = False) -> DataFrame:
    """Runs ``compare`` on every leaf with itself and on the pairs of leaves that the boxes leave; with ``marked``, where marks differ."""

    def side(columns: list[pa.Array], row: int) -> Leaf:
        ids, marks, counts = (columns[k][row].as_py() for k in range(3))
        fine = [_fine(c) for c in counts]
        points = _points(fine)
        # Views of the batch, which stays until both leaves are compared.
        shingles_, bits = (np.frombuffer(columns[k][row].as_buffer() or b"", kind) for k, kind in ((3, "<u8"), (4, np.uint8)))
        if len(shingles_) and not len(bits):
            shingles_, bits = _packed(np.split(shingles_, np.cumsum(points.sum(1))[:-1]))
        return np.array(ids, np.int64), np.array(marks, np.int64), points, shingles_, bits.reshape(len(ids), -1), fine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            own = part.num_columns == 5
            left = side(part.columns[:5], 0)
            out = compare(left, left if own else side(part.columns[5:], 0), own)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [f.split()[0] for f in made.split(", ")])

    names = ["ids", "marks", "counts", "shingles", "bits"]
    alone = leaf.where("array_min(marks) < array_max(marks)" if marked else "size(ids) > 1").select(*names).mapInArrow(run, made)
    pairs = leaf_pairs(leaf, rule, marked).select(*[f"{c}_{s}" for s in "ab" for c in names])
    return alone.unionAll(pairs.mapInArrow(run, made))


def may_link(rule: Rule) -> Compare:
    """Pairs of documents with different marks that the bound leaves, as far as they connect something."""

    def compare(left: tuple, right: tuple, own: bool) -> tuple[list, list]:
        ids_a, marks_a, points_a, *_, fine_a = left
        ids_b, marks_b, points_b, *_, fine_b = right
        # Most have one mark, and need not meet each other.
        values, times = np.unique(np.concatenate((marks_a, marks_b)), return_counts=True)
        usual = values[times.argmax()]
        odd_a, odd_b = marks_a != usual, marks_b != usual
        pairs = []
        for rows, columns in ((odd_a, np.ones(len(ids_b), bool)), *(() if own else ((~odd_a, odd_b),))):
            rows, columns = np.flatnonzero(rows), np.flatnonzero(columns)
            if len(rows) and len(columns):
                i, j = np.nonzero(_survivors(points_a[rows], points_b[columns], rule) & (marks_a[rows][:, None] != marks_b[columns][None, :]))
                i, j = rows[i], columns[j]
                ok = _still(fine_a, fine_b, i, j, rule)
                pairs.append((i[ok], j[ok]))
        if not pairs:
            return [], []
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        shift = 0 if own else len(ids_a)
        kept = _forest(shift + len(ids_b), zip(i.tolist(), (j + shift).tolist(), strict=True))
        return [int(ids_a[x]) for x, _ in kept], [int(ids_b[y - shift]) for _, y in kept]

    return compare


# Shingles whose bits are opened up at a time.
COLUMNS = 8_192


def _overlaps(left: Leaf, right: Leaf, own: bool) -> np.ndarray:
    """Exact sizes of the intersections of the sets of two leaves, or of one with itself."""
    bits_a, bits_b = left[4], right[4]
    total = np.zeros((len(bits_a), len(bits_b)), np.int64)
    if own:
        for at in range(0, bits_a.shape[1], COLUMNS // 8):
            block = np.unpackbits(bits_a[:, at : at + COLUMNS // 8], axis=1).astype(np.float32)
            total += (block @ block.T).astype(np.int64)
        return total
    # Both are in order, so one pass finds what they share.
    _, at_a, at_b = np.intersect1d(left[3], right[3], assume_unique=True, return_indices=True)
    for at in range(0, len(at_a), COLUMNS):
        blocks = []
        for bits, places in ((bits_a, at_a[at : at + COLUMNS]), (bits_b, at_b[at : at + COLUMNS])):
            blocks.append(((bits[:, places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).astype(np.float32))
        total += (blocks[0] @ blocks[1].T).astype(np.int64)
    return total


def linked(rule: Rule) -> Compare:
    """Exact links: for each document and side how many documents it links with, and links that connect.

    Rows are (u, v, links_u, links_v); a row with v null-like -1 carries counts only.  Marks are the
    numbers of documents with that same set.
    """

    def compare(left: tuple, right: tuple, own: bool) -> tuple[list, ...]:
        ids_a, weight_a, points_a, *_ = left
        ids_b, weight_b, points_b, *_ = right
        open_ = _survivors(points_a, points_b, rule)
        if own:
            np.fill_diagonal(open_, False)
        if not open_.any():
            return [], [], []
        over = _overlaps(left, right, own)
        union = points_a.sum(1)[:, None] + points_b.sum(1)[None, :] - over
        yes = (rule.den * over >= rule.num * union) & open_
        out: list[list[int]] = [[], [], []]
        for ids, add in ((ids_a, yes @ weight_b), *(() if own else ((ids_b, weight_a @ yes),))):
            for k in np.flatnonzero(add):
                out[0].append(int(ids[k]))
                out[1].append(int(ids[k]))
                out[2].append(int(add[k]))
        i, j = np.nonzero(np.triu(yes, 1) if own else yes)
        shift = 0 if own else len(ids_a)
        for x, y in _forest(shift + len(ids_b), zip(i.tolist(), (j + shift).tolist(), strict=True)):
            out[0].append(int(ids_a[x]))
            out[1].append(int(ids_b[y - shift]))
            out[2].append(0)
        return tuple(out)

    return compare


def _bound_filter(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Keeps (u, v, counts_u, counts_v) that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            fine = [[_fine(c) for c in part.column(k).to_pylist()] for k in (2, 3)]
            a, b = (_points(f).astype(np.int64) for f in fine)
            ok = np.minimum(a, b).sum(1) >= rule.overlap(a.sum(1) + b.sum(1))
            at = np.flatnonzero(ok)
            ok[at] = _still(*fine, at, at, rule)
            yield part.select([0, 1]).filter(pa.array(ok))

    return pairs.select("u", "v", "counts_u", "counts_v").mapInArrow(run, "u long, v long")


def join(docs: DataFrame, num: int = 90, den: int = 100, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``.

    Two documents link when ``den`` * intersection >= ``num`` * union of their sets of word shingles.
    component_id is the smallest id reachable by links, n_links the number of other documents linked
    directly.  Null, empty and wordless texts have an empty set and link with nothing.  Rows with a null id
    link with nothing either and have a null component; rows that repeat an id with equal texts count as
    one document (each such row comes back).  Texts may be of any length.  Ties do not arise: links are
    decided in whole numbers.  Other columns are not read.
    """
    rule = Rule(num, den)
    rows = settle(signatures(docs, rule, shingle, id_col, text_col))
    sets = rows.where("n > 0 and doc_id is not null")
    classes = settle(sets.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies")))
    others = sets.join(classes.select("whole", "rep"), "whole").where("doc_id <> rep").select("doc_id").distinct()
    points = sets.join(small_side(settle(others)), "doc_id", "left_anti")
    keyed = points.select(F.explode("keys").alias("key"), "doc_id", "n")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "n")).alias("top")).where("m > 1")
    members = settle(keyed.join(buckets.select("key", "m", "top"), "key"))

    # Pairs of small buckets, at most FEW / 2 for each member, and of large ones those with the smallest member.
    few, many = members.where(F.col("m") <= FEW), members.where(F.col("m") > FEW)
    left, right = (few.select("key", F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}")) for c in "uv")
    near = (F.col("n_u") * rule.den >= F.col("n_v") * rule.num) & (F.col("n_v") * rule.den >= F.col("n_u") * rule.num)
    spokes = many.where("doc_id <> top.doc_id").select(F.col("top.doc_id").alias("u"), F.col("top.n").alias("n_u"), F.col("doc_id").alias("v"), F.col("n").alias("n_v"))
    pairs = left.join(right, "key").where("u < v").drop("key").unionAll(spokes.select("u", "n_u", "v", "n_v"))
    pairs = settle(pairs.where(near).select("u", "v").distinct())
    u, v = (points.select(F.col("doc_id").alias(c), F.col("counts").alias(f"counts_{c}")).dropDuplicates([c]) for c in "uv")
    first = settle(_bound_filter(pairs.join(u, "u").join(v, "v"), rule))
    tied = components(first).select(F.col("node").alias("doc_id"), F.col("root"))
    marked = many.join(tied, "doc_id", "left").select("key", "m", "doc_id", F.coalesce("root", "doc_id").alias("mark"))
    apart = marked.groupBy("key").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo < hi").select("key")
    rest = marked.join(apart, "key").join(points.select("doc_id", "n", "counts"), "doc_id")
    rest = rest.select(F.col("key").alias("tree"), F.col("m").alias("members"), "doc_id", "n", "mark", "counts", F.lit(b"").alias("body"))
    second = walk(leaves(rest, rule), rule, may_link(rule), "u long, v long", marked=True)
    family = components(first.unionAll(second)).select(F.col("node").alias("rep"), F.col("root").alias("tree"))
    sizes = family.groupBy("tree").agg(F.count(F.lit(1)).alias("members"))
    wanted = settle(family.join(sizes, "tree").join(classes.select("rep", "copies"), "rep"))

    bodies = _bodies(docs, small_side(wanted), shingle, id_col, text_col)
    found = settle(walk(leaves(bodies, rule), rule, linked(rule), "u long, v long, add long"))
    roots = components(found.where("u <> v").select("u", "v"))
    links = found.where("u = v").groupBy("u").agg(F.sum("add").alias("more"))
    classes = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(links.withColumnRenamed("u", "rep"), "rep", "left")
    final = classes.select("whole", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    out = rows.select("doc_id", "n", "whole").join(settle(final), "whole", "left")
    has = F.col("doc_id").isNotNull()
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(has, F.coalesce("root", "doc_id")).alias("component_id"),
        F.when(has, F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"),
    )


def _bodies(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Rows for ``leaves`` with whole sets, of the documents in families, from their texts; the mark is the number of equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, WHOLE_SETS):
            sets = [_set_of(t, shingle) for t in part.column(4).to_pylist()]
            counts = pa.array([_counts(x) if len(x) else b"" for x in sets], pa.binary())
            arrays = [*part.columns[:4], pa.array([len(x) for x in sets], pa.int64()), counts, pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["tree", "members", "doc_id", "mark", "n", "counts", "body"])

    kept = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").cast("binary").alias("t"))
    kept = kept.join(wanted, "rep").select("tree", "members", "rep", "copies", "t")
    made = "tree long, members long, doc_id long, mark long, n long, counts binary, body binary"
    return kept.mapInArrow(run, made).where("n > 0")


def one_of_each(docs: DataFrame, num: int = 80, den: int = 100, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: those whose id is the smallest in it, and rows without id."""
    found = join(docs, num, den, shingle, id_col, text_col)
    gone = settle(found.where(f"`{id_col}` <> component_id").select(F.col(id_col).alias("gone_id")).distinct())
    return docs.join(small_side(gone), docs[id_col] == F.col("gone_id"), "left_anti")
