"""Byte-level BPE by a transducer: bytes in, tokens out as soon as nothing that follows can change them.

A token sequence is what the merges give exactly if each two neighbours are: merging their joined
bytes gives the two back.  So the last token of every prefix follows from the last tokens of shorter
prefixes.  A position of the text is live while some token may still begin there; tokens before the
point where the chains of all live positions meet are settled and are emitted.  A state is the last
settled token and the bytes since; states and their moves are worked out when first met.

Repeated chunks of text are looked up in a bounded memo of what the transducer gave for them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.store import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
START = -1
# Entries kept at most in a worker: memo of chunks, states of the transducer, tested pairs.  They change speed only;
# with fewer ``entries`` in the memo, states and pairs are fewer in proportion.
MEMO, STATES, PAIRS = 600_000, 260_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class State(dict):
    """Byte: the state after it and the tokens then settled, as far as met.

    ``live``: positions of the tail where a token may still begin or end, the first one first.

    ``back``: for positions on the way to a live one, where the last token before it begins, and that token.
    """

    __slots__ = ("back", "ends", "live", "owner", "tail", "token")

    def __init__(self, owner: Transducer, token: int, tail: bytes, live: list[int], back: dict[int, tuple[int, int]]):
        super().__init__()
        self.owner, self.token, self.tail, self.live, self.back = owner, token, tail, live, back
        self.ends: tuple[int, ...] | None = None

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        return self.owner.move(self, byte)

    @property
    def final(self) -> tuple[int, ...]:
        """The tokens of the tail if the run ends here."""
        if self.ends is None:
            self.ends = chain(self.back, len(self.tail))
        return self.ends


def chain(back: dict[int, tuple[int, int]], end: int) -> tuple[int, ...]:
    """The tokens up to a position."""
    out = []
    while end:
        end, token = back[end]
        out.append(token)
    return tuple(out[::-1])


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {rank: token for token, rank in ranks.items()}
        # What longer tokens begin with: -1, or the rank where that is a token itself; other tokens: -2 less the rank.
        self.known = {token[:n]: -1 for token in ranks for n in range(1, len(token))}
        self.known |= {token: rank if token in self.known else -2 - rank for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[bytes, bool], list[tuple[bytes, int, int]]] = {}
        self.states: dict[tuple, State] = {}
        self.most_states, self.most_pairs = STATES, PAIRS
        self.start = State(self, START, b"", [0], {})

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int, int]]:
        """What stands at one edge of a token while it is merged: part, rank that makes it, rank that ends it."""
        found = self.edges.get((token, right))
        if found is None:
            parts, seen, born = [token[i : i + 1] for i in range(len(token))], [], -1
            at = -1 if right else 0
            edge = parts[at]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if parts[at] != edge:
                    seen.append((edge, born, rank))
                    edge, born = parts[at], rank
            seen.append((edge, born, 1 << 60))
            found = self.edges[token, right] = seen
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two back: no merge crosses the border between them.

        Parts at both edges that exist at the same time would merge if their joint rank came before
        the rank that ends either; of equal ranks the left one goes first.
        """
        if left == START:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            ends, begins = self.spine(self.text[left], True), self.spine(self.text[right], False)
            found, i, j = True, 0, 0
            while found and i < len(ends) and j < len(begins):
                (a, _, dead), (b, _, gone) = ends[i], begins[j]
                rank = self.ranks.get(a + b, 1 << 60)
                if rank < dead and rank <= gone and rank < 1 << 60:
                    found = False
                i, j = i + (dead <= gone), j + (gone < dead)
            self.pairs[left, right] = found
        return found

    def forget(self) -> None:
        """Drops all states; their moves point at each other in rings, which are cut here."""
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.start.clear()

    @staticmethod
    def meet(live: list[int], back: dict[int, tuple[int, int]]) -> int:
        """The last position that the chains of all live positions share."""
        at = live[-1]
        for other in live[-2::-1]:
            while at != other:
                if at > other:
                    at = back[at][0]
                else:
                    other = back[other][0]
        return at

    @staticmethod
    def ways(live: list[int], back: dict[int, tuple[int, int]], settled: int) -> dict[int, tuple[int, int]]:
        """What remains of ``back`` on the chains of live positions, counted from the settled one."""
        rest: dict[int, tuple[int, int]] = {}
        for at in live:
            while at > settled and at - settled not in rest:
                begin, by = back[at]
                rest[at - settled] = (begin - settled, by)
                at = begin
        return rest

    def move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        tail = state.tail + bytes((byte,))
        n, known, pairs, before = len(tail), self.known, self.pairs, state.back
        live, last = [], None
        for begin in state.live:
            token = known.get(tail[begin:])
            if token is None:
                continue
            if token >= -1:
                live.append(begin)
            else:
                token = -2 - token
            if last is None and token >= 0:
                left = before[begin][1] if begin else state.token
                fits = pairs.get((left, token))
                if self.fits(left, token) if fits is None else fits:
                    last = (begin, token)
        if not live:
            emitted = (*chain(before, last[0]), last[1])
            live, token, settled, back = [n], last[1], n, {}
        else:
            live.append(n)
            back = {**before, n: last}
            settled = self.meet(live, back)
            emitted = chain(back, settled)
            token = emitted[-1] if emitted else state.token
        rest = None
        if live[0] == settled:
            key = (token, tail[settled:])
        else:
            rest = self.ways(live, back, settled)
            key = (tuple(rest.items()), tail[settled:])
        after = self.states.get(key)
        if after is None:
            if len(self.states) >= self.most_states:
                self.forget()
            if rest is None:
                rest = self.ways(live, back, settled)
            after = self.states[key] = State(self, token, tail[settled:], [at - settled for at in live], rest)
        step = state[byte] = (after, emitted)
        return step

    def run(self, data: Iterable[int]) -> list[int]:
        """The tokens of a run of bytes."""
        out: list[int] = []
        state = self.start
        for byte in data:
            state, emitted = state[byte]
            if emitted:
                out += emitted
        out += state.final
        return out

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The same tokens one by one, each as soon as it is settled."""
        state = self.start
        for byte in data:
            state, emitted = state[byte]
            yield from emitted
        yield from state.final


# Characters with the property White_Space.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(kind: str) -> str:
    """Character ranges of a general category, for the standard pattern module, which is the fastest here."""
    out, begin = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == kind
        if inside and begin is None:
            begin = code
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{code - 1:08x}")
            begin = None
    return "".join(out)


def splitter(pattern: str = public_tokenizers.PATTERN) -> re.Pattern:
    """The public pattern with its properties written out as ranges."""
    outside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{_class('L')}{_class('N')}]")
    for name, chars in ((r"\p{L}", _class("L")), (r"\p{N}", _class("N")), (r"\S", "^" + SPACES), (r"\s", SPACES)):
        outside = outside.replace(name, f"[{chars}]")
    return re.compile(outside)


DOUBLE_SPACE = re.compile(r"\s\s")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Memo(dict):
    def __init__(self, work: Callable[[str], bytes], lead: str = ""):
        super().__init__()
        self.work, self.lead, self.most = work, lead, MEMO

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.work(self.lead + chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found


class Codec:
    """Encodes texts to ids and back; one for each worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.fst = Transducer(ranks)
        if not _splitters:
            _splitters.append(splitter())
        self.split = _splitters[0]
        self.pieces, self.first, self.later = Memo(self.piece), Memo(self.chunk), Memo(self.chunk, " ")
        self.table = [self.fst.text.get(i) for i in range(max(self.fst.text) + 1)]

    def bound(self, entries: int) -> Codec:
        for memo in (self.pieces, self.first, self.later):
            memo.most = entries
        self.fst.most_states, self.fst.most_pairs = max(1, entries * STATES // MEMO), max(1, entries * PAIRS // MEMO)
        return self

    def chunk(self, text: str) -> bytes:
        return b"".join([self.pieces[piece] for piece in self.split.findall(text)])

    def piece(self, text: str) -> bytes:
        ids = array("I", self.fst.run(text.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space between two other characters always begins a match of the pattern, so the
        text may be cut before such spaces and its chunks looked up.
        """
        if not text:
            return b""
        chunks = LONE_SPACE.split(text) if DOUBLE_SPACE.search(text) else text.split(" ")
        later = self.later
        if chunks[0]:
            return b"".join([self.first[chunks[0]], *[later[c] for c in chunks[1:]]])
        return b"".join([later[c] for c in chunks[1:]])

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join([table[i] for i in numbers])


class Utf8Stream:
    """Text of bytes that arrive in pieces: characters come out once whole, what is cut off waits.

    ``missing`` counts the bytes that the character begun last still needs.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def missing(data: bytes) -> int:
        for seen in range(1, min(4, len(data)) + 1):
            byte = data[-seen]
            if byte & 0xC0 != 0x80:
                need = 1 if byte < 0x80 else 2 if byte & 0xE0 == 0xC0 else 3 if byte & 0xF0 == 0xE0 else 4
                return max(0, need - seen)
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        wait = self.missing(data)
        keep = 0
        if wait:
            keep = next(n for n in range(1, 5) if data[-n] & 0xC0 != 0x80)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(codec: Codec, ids: bytes, step: int = 1 << 16) -> Iterator[str]:
    """Text of encoded ids, ``step`` ids at a time."""
    stream = Utf8Stream()
    for at in range(0, len(ids), 4 * step):
        yield stream.feed(codec.decode(ids[at : at + 4 * step]))
    yield stream.close()


_codecs: dict[str, Codec] = {}
_splitters: list[re.Pattern] = []


def codec_of(path: str) -> Codec:
    if path not in _codecs:
        gc.disable()  # a worker keeps many states, and no rings of objects are left behind
        _codecs[path] = Codec(read_ranks(path))
    return _codecs[path]


def release(codec: Codec) -> None:
    """Frees all that a task built up, as the worker may turn to other work."""
    codec.fst.forget()
    # Memos and codec point at each other, so they are emptied here, not left to the collector.
    for memo in (codec.pieces, codec.first, codec.later):
        memo.clear()
    _codecs.clear()
    gc.enable()
    gc.collect()


def shipped(docs: DataFrame, path: str) -> str:
    """The vocabulary as a file that every executor fetches; its name."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens) of whole texts; a null text is an empty one, a null id stays null.

    Rows are mapped one by one: repeated rows, ties and other columns make no difference, and an
    empty table gives an empty one.
    """
    name = shipped(docs, path or public_tokenizers.path(VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(SparkFiles.get(name))
        for part in slices(batches):
            ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
            counts = [len(x) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.int64())], ["id", "ids", "n_tokens"])
        release(codec)

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return kept.mapInArrow(run, "id long, ids binary, n_tokens long").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of encoded rows, by the streaming decoder.

    Null ids give a null text and no ids an empty one; a null id of the row stays null.  Rows are mapped one by
    one, so repeats, ties and other columns make no difference, texts may be of any length, and an empty table
    gives an empty one.  Ids beyond the vocabulary fail.
    """
    name = shipped(encoded, path or public_tokenizers.path(VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(SparkFiles.get(name))
        for part in slices(batches):
            texts = [None if x is None else "".join(decode_stream(codec, x)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])
        release(codec)

    kept = encoded.select(F.col(id_col).cast("long").alias("id"), F.col("ids"))
    return kept.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", entries: int = MEMO) -> DataFrame:
    """Encodes and decodes in one pass: (id, n_tokens, ids_sha256, decoded_sha256, ids); edge cases as in ``encode``.

    ``entries`` bounds a worker's memo: fewer cost time, not results.
    """
    name = shipped(docs, path or public_tokenizers.path(VOCABULARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(SparkFiles.get(name)).bound(entries)
        for part in slices(batches, 64):
            out: list[list] = [[], [], [], []]
            for text in part.column(1).to_pylist():
                ids = codec.encode(text or "")
                back = hashlib.sha256()
                for piece in decode_stream(codec, ids):
                    back.update(piece.encode())
                for column, value in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest(), ids), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary())
            arrays = [part.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
        release(codec)

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    made = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    return kept.mapInArrow(run, made).withColumnRenamed("id", id_col)
