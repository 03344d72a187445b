"""SentencePiece BPE by vectorised merge rounds: encoding and decoding with a given model file.

The symbols of many words lie in one flat array.  A round looks up the rank of every pair of
neighbours, takes the least rank of each word, merges its occurrences from the left all at once, and
compacts the array; words without a pair are done.  A merge ends a word's round if it makes a pair of
no higher rank, since that pair comes before the occurrences to its right.

Words met lately are looked up in a bounded memo of what the rounds gave for them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.bpe import shipped
from gridcast.llm.store import slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Kinds of pieces in a model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.int32(np.iinfo(np.int32).max)
# Words kept at most in a worker's memo: a bound on memory, not on results.
MEMO = 600_000
# Rounds take the square of a word's length in the worst case; longer stretches are merged pair by pair from a heap.
LONG = 2_048


class Vocabulary:
    """Symbols, and for each pair of them that joins to a piece its rank and the piece.

    The model must be of kind BPE, normalise nothing, add a space at the beginning and keep white space
    as it is; other models fail.  ``surface`` holds the bytes each id stands for.
    """

    def __init__(self, path: str):
        model = _read_model(path)
        self.unknown = model["unknown"]
        self.surface: list[bytes] = []
        symbols: dict[str, int] = {}
        self.bytes_of = np.full(256, -1, np.int32)
        kinds, names, scores = model["kinds"], model["names"], model["scores"]
        for i, (kind, name) in enumerate(zip(kinds, names, strict=True)):
            if kind == BYTE:
                value = int(name[3:-1], 16)
                self.bytes_of[value] = i
                self.surface.append(bytes([value]))
            elif kind == CONTROL:
                self.surface.append(b"")
            elif kind == UNKNOWN:
                self.surface.append(model["unknown_surface"].encode())
            else:
                if kind != NORMAL:
                    raise ValueError("user-defined and unused pieces are not supported")
                symbols[name] = i
                self.surface.append(name.replace(SPACE, " ").encode())
        self.spaced = {i for s, i in symbols.items() if s.startswith(SPACE)}
        self.numbers = [str(i) for i in range(len(names))]
        # Characters that only occur inside pieces are symbols too, behind the ids.
        for name in list(symbols):
            for c in name:
                symbols.setdefault(c, len(names) + len(symbols))
        self.pieces = len(names)
        self.width = 1 + max(symbols.values())
        order = {s: r for r, s in enumerate(sorted({scores[i] for s, i in symbols.items() if i < self.pieces}, reverse=True))}
        rules = []
        for name, i in symbols.items():
            if i < self.pieces:
                for cut in range(1, len(name)):
                    left, right = symbols.get(name[:cut]), symbols.get(name[cut:])
                    if left is not None and right is not None:
                        rules.append((left * self.width + right, order[scores[i]], i))
        rules.sort()
        self.keys = np.array([k for k, _, _ in rules] or [-1], np.int64)
        self.ranks = np.array([r for _, r, _ in rules] or [NONE], np.int32)
        self.made = np.array([m for _, _, m in rules] or [-1], np.int32)
        self.rule_of = {k: (r, m) for k, r, m in rules}
        self.char_of = np.full(0x110000, -1, np.int32)
        for name, i in symbols.items():
            if len(name) == 1:
                self.char_of[ord(name)] = i
        inner = {name[i : i + 2] for name, s in symbols.items() if s < self.pieces for i in range(len(name) - 1)}
        met = [(self.char_of[ord(a)], self.char_of[ord(b)]) for a, b in inner]
        # Neighbours that no piece holds are never merged: words are cut there.
        self.inner = np.unique(np.array([int(a) * self.width + int(b) for a, b in met] or [-1], np.int64))
        spaced = any(a != SPACE and b == SPACE for a, b in inner)
        self.words = re.compile("(?s:.+)" if spaced else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.run = self._filled(symbols, scores)

    def _filled(self, symbols: dict[str, int], scores: list[float]) -> int:
        """Long runs of spaces fill up with pieces of so many from the left, whatever follows; 0 if the model does not say so.

        That is so where pieces of spaces alone rank alike and behind all others, which hold no two spaces.
        """
        pieces = [s for s, i in symbols.items() if i < self.pieces and len(s) > 1]
        alone = [s for s in pieces if not s.strip(SPACE)]
        ranks = {scores[symbols[s]] for s in alone}
        others = [s for s in pieces if s.strip(SPACE)]
        if len(ranks) != 1 or any(SPACE * 2 in s or scores[symbols[s]] <= min(ranks) for s in others):
            return 0
        most = max(map(len, alone))
        one, whole = symbols[SPACE], symbols[SPACE * most]
        got = {n: merge_one([one] * n, self) for n in range(1, 4 * most)}
        return most if all(got[n] == [whole, *got[n - most]] for n in range(most + 1, 4 * most)) else 0

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE where there is none, and the place of its rule."""
        wanted = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), at


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of the fields of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at += 1
            if data[at - 1] < 0x80:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, kind, value


def _read_model(path: str) -> dict:
    """Pieces and settings of a model file."""
    out: dict = {"names": [], "scores": [], "kinds": [], "unknown_surface": " ⁇ "}
    trainer: dict[int, object] = {}
    normal: dict[int, object] = {}
    with open(path, "rb") as file:
        for number, _, value in _fields(file.read()):
            if number == 1:
                piece = {n: v for n, _, v in _fields(value)}
                out["names"].append(piece[1].decode())
                out["scores"].append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                out["kinds"].append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = {n: v for n, _, v in _fields(value)}
            elif number == 3:
                normal = {n: v for n, _, v in _fields(value)}
    # Numbers of the settings in the file format: 3 model type (2 is BPE), 24 white space as suffix, 35 byte fallback,
    # 44 text of the unknown piece; of the normaliser 2 rules, 3 dummy prefix, 4 extra white space, 5 escaped spaces.
    if trainer.get(3) != 2 or trainer.get(24) or not trainer.get(35):
        raise ValueError("the model must be a BPE model with byte fallback")
    if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("the model must not normalise, but add a space at the beginning and keep white space")
    if 44 in trainer:
        out["unknown_surface"] = trainer[44].decode()
    out["unknown"] = out["kinds"].index(UNKNOWN)
    return out


def merge_rounds(symbols: np.ndarray, word: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merges the symbols of all words; ``word`` (ascending) says whose each symbol is.  Returns what is left of both, by word."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols) > 1:
        rank, rule = vocabulary.pairs(symbols[:-1], symbols[1:])
        rank = np.where(word[:-1] == word[1:], rank, NONE)
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sizes = np.diff(np.append(starts, len(word)))
        least = np.minimum.reduceat(np.append(rank, NONE), starts)
        live = np.repeat(least < NONE, sizes)
        if not live.all():
            done.append((symbols[~live], word[~live]))
            if not live.any():
                symbols, word = symbols[:0], word[:0]
                break
            keep = np.flatnonzero(live)
            # Neighbours stay neighbours, as whole words go.
            symbols, word, rank, rule = symbols[keep], word[keep], np.append(rank, NONE)[keep][:-1], np.append(rule, 0)[keep][:-1]
            sizes, least = sizes[least < NONE], least[least < NONE]
        hit = rank == np.repeat(least, sizes)[:-1]
        # In a row of overlapping occurrences every second one counts, from the left.
        at = np.flatnonzero(hit)
        fresh = np.concatenate(([True], np.diff(at) > 1))
        first = np.flatnonzero(fresh)
        at = at[((np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) & 1) == 0]
        made = vocabulary.made[rule[at]]
        # The pairs that a merge makes: with what lies left of it by then, and with what lies right of it still.
        before = np.concatenate(([-1], symbols))[at]
        before[np.concatenate(([-1], word))[at] != word[at]] = -1
        joined = np.flatnonzero(np.diff(at) == 2) + 1
        joined = joined[word[at[joined]] == word[at[joined - 1]]]
        before[joined] = made[joined - 1]
        after = np.append(symbols, (-1, -1))[at + 2]
        after[np.append(word, (-1, -1))[at + 2] != word[at]] = -1
        least_of = rank[at]
        stops = (vocabulary.pairs(before, made)[0] <= least_of) | (vocabulary.pairs(made, after)[0] <= least_of)
        if stops.any():
            # Of each word's occurrences those after the first that stops wait for the next round.
            owner = word[at]
            group = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            passed = np.cumsum(stops) - stops
            passed -= np.repeat(passed[group], np.diff(np.append(group, len(at))))
            at, made = at[passed == 0], made[passed == 0]
        symbols = symbols.copy()
        symbols[at] = made
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, word = symbols[keep], word[keep]
    done.append((symbols, word))
    symbols, word = (np.concatenate(c) for c in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def merge_one(symbols: list[int], vocabulary: Vocabulary) -> list[int]:
    """The same for one long stretch, pair by pair from a heap of (rank, place)."""
    rules, width = vocabulary.rule_of, vocabulary.width
    held = list(symbols)
    right = list(range(1, len(held) + 1))
    left = list(range(-1, len(held) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(held) and held[i] >= 0 and held[j] >= 0:
            found = rules.get(held[i] * width + held[j])
            if found:
                heapq.heappush(heap, (found[0], i, held[i], held[j]))

    for i in range(len(held) - 1):
        offer(i, i + 1)
    gone = [False] * len(held)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if gone[i] or j >= len(held) or held[i] != a or held[j] != b:
            continue
        held[i] = rules[a * width + b][1]
        gone[j] = True
        right[i] = right[j]
        if right[j] < len(held):
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [s for s, g in zip(held, gone, strict=True) if not g]


class Codec:
    """Encoder and decoder with a memo of words."""

    def __init__(self, path: str, entries: int = MEMO):
        self.vocabulary = Vocabulary(path)
        self.entries = entries
        self.memo: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Stretches of a text that no piece crosses, the space at its beginning included; none of an empty text."""
        if not text:
            return []
        found = self.vocabulary.words.findall(SPACE + text.replace(" ", SPACE))
        run = self.vocabulary.run
        if run and SPACE * (run + 1) in text.replace(" ", SPACE) + SPACE:
            cut: list[str] = []
            for w in found:
                while w.startswith(SPACE * (run + 1)):
                    cut.append(w[:run])
                    w = w[run:]
                cut.append(w)
            return cut
        return found

    def learn(self, words: Iterable[str]) -> None:
        """Merges the words that the memo lacks, all at once, and remembers their ids."""
        v = self.vocabulary
        wanted = dict.fromkeys(words)
        fresh = [w for w in wanted if w not in self.memo]
        if not fresh:
            return
        if len(self.memo) + len(fresh) > self.entries:
            self.memo.clear()
            fresh = list(wanted)
        points = np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = v.char_of[points]
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        owner = np.repeat(np.arange(len(fresh)), sizes)
        # Symbols without id keep their code point, below zero.
        symbols = np.where(symbols >= 0, symbols, -1 - points.astype(np.int64)).astype(np.int32)
        key = symbols[:-1].astype(np.int64) * v.width + symbols[1:]
        at = np.minimum(np.searchsorted(v.inner, key), len(v.inner) - 1)
        tied = (v.inner[at] == key) & (owner[1:] == owner[:-1]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        part = np.concatenate(([0], np.cumsum(~tied)))
        owner_of = owner[np.flatnonzero(np.concatenate(([True], ~tied)))]
        lengths = np.bincount(part)
        if lengths.max() > LONG:
            small = lengths[part] <= LONG
            merged = [merge_rounds(symbols[small], part[small], v)]
            for p in np.flatnonzero(lengths > LONG):
                ids = np.array(merge_one(symbols[part == p].tolist(), v), np.int32)
                merged.append((ids, np.full(len(ids), p)))
            symbols, part = (np.concatenate(c) for c in zip(*merged, strict=True))
            order = np.argsort(part, kind="stable")
            symbols, part = symbols[order], part[order]
        else:
            symbols, part = merge_rounds(symbols, part, v)
        owner = owner_of[part]
        if len(symbols) and (symbols.min() < 0 or symbols.max() >= v.pieces):
            symbols, owner = self._fall_back(symbols, owner)
        ends = np.cumsum(np.bincount(owner, minlength=len(fresh)))
        flat = symbols.astype("<i4").tobytes()
        begin = 0
        for w, end in zip(fresh, ends.tolist(), strict=True):
            self.memo[w] = flat[4 * begin : 4 * end]
            begin = end

    def _fall_back(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become their bytes."""
        v = self.vocabulary
        other = np.flatnonzero((symbols < 0) | (symbols >= v.pieces))
        lone = {int(v.char_of[p]): p for p in np.flatnonzero(v.char_of >= v.pieces).tolist()}
        found = [chr(-1 - s if s < 0 else lone[s]).encode("utf-8", "surrogatepass") for s in symbols[other].tolist()]
        times = np.ones(len(symbols), np.int64)
        times[other] = [len(b) for b in found]
        begins = (np.cumsum(times) - times)[other]
        ids, whose = np.repeat(symbols, times), np.repeat(owner, times)
        places = np.repeat(begins - np.concatenate(([0], np.cumsum(times[other])[:-1])), times[other]) + np.arange(times[other].sum())
        bytes_ = v.bytes_of[np.frombuffer(b"".join(found), np.uint8)]
        ids[places] = np.where(bytes_ >= 0, bytes_, v.unknown)
        return ids, whose

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; what they lack in the memo is merged together."""
        found = [self.words(t) for t in texts]
        if sum(map(len, found)) <= self.entries:
            self.learn(w for words in found for w in words)
            return [self._joined(words) for words in found]
        out = []
        for words in found:
            pieces = []
            for begin in range(0, len(words), self.entries):
                self.learn(words[begin : begin + self.entries])
                pieces.append(self._joined(words[begin : begin + self.entries]))
            out.append(np.concatenate(pieces) if pieces else np.empty(0, np.int32))
        return out

    def _joined(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, words)), "<i4")

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the space at the beginning goes, bytes that make no character become U+FFFD each."""
        held = b"".join(map(self.vocabulary.surface.__getitem__, ids))
        if held[:1] == b" " and next(i for i in ids if self.vocabulary.surface[i]) in self.vocabulary.spaced:
            held = held[1:]
        try:
            return held.decode()
        except UnicodeDecodeError:
            return _repaired(held)


def _repaired(held: bytes) -> str:
    out = []
    at = 0
    while at < len(held):
        for size in (1, 2, 3, 4):
            try:
                out.append(held[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens) of whole texts.

    A null text is an empty one and has no ids; a null id stays null.  Rows are mapped one by one, so
    ties, repeated rows and other columns make no difference; an empty table gives an empty one, and
    texts may be of any length.
    """
    name = shipped(docs, path or public_tokenizers.path(MODEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(SparkFiles.get(name))
        for part in slices(batches):
            ids = codec.encode([t or "" for t in part.column(1).to_pylist()])
            counts = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), counts], ["id", "ids", "n_tokens"])

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return kept.mapInArrow(run, "id long, ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows with ``ids``; null ids give a null text, no ids an empty one; other columns are not read.

    Ids beyond the vocabulary and null ids inside an array fail.  Rows are mapped one by one.
    """
    name = shipped(encoded, path or public_tokenizers.path(MODEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(SparkFiles.get(name))
        for part in slices(batches):
            texts = [None if x is None else codec.decode(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kept = encoded.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("ids"))
    return kept.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: (id, n_tokens, ids_sha256, decoded_sha256); edge cases as in ``encode``.

    Digests are those of the decimal ids joined by commas, and of the decoded text in UTF-8.
    """
    name = shipped(docs, path or public_tokenizers.path(MODEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(SparkFiles.get(name))
        numbers = codec.vocabulary.numbers
        for part in slices(batches, 64):
            out: list[list] = [[], [], []]
            for found in codec.encode([t or "" for t in part.column(1).to_pylist()]):
                ids = found.tolist()
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join([numbers[i] for i in ids]).encode()).hexdigest())
                out[2].append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    made = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return kept.mapInArrow(run, made).withColumnRenamed("id", id_col)
