"""Substring dedup by sliding spans of sentences and their pieces.

Every run of consecutive pieces that is long enough is hashed; runs meet by hash over the whole
corpus, and pieces covered by a run that is not the first of its kind are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from gridcast.llm.store import settle, slices

# A run has at least so many sentences and words; a piece of a sentence has at most PIECE words.
SENTENCES, WORDS, PIECE = 3, 20, 16
# A sentence is cut after a word whose hash is the least of so many words on either side.
NEAR = 3
END = re.compile(rb"[.!?]+\s+|\s*\n\s*")
WORD = re.compile(rb"\s*\S+\s*")
# So many hashes at most are taken for common ones.
HOT = 1_000
# Columns of the stored rows beside their own.
ROW, ID, DIGEST, TOTAL, RUNS = "_span_row", "_span_id", "_span_digest", "_span_total", "_span_runs"


def cuts(words: list[bytes]) -> list[int]:
    """After how many words a sentence is cut: where a word's hash is the least nearby, so that a passage is cut alike wherever it lies.

    Of equal hashes the first counts.  Stretches without such a word are cut after the least one of the
    next PIECE, the last of equal ones.
    """
    size = len(words)
    if size <= 2 * NEAR:
        return []
    ranks = list(map(crc32, words))
    found: list[int] = []
    at, to = NEAR, size - NEAR
    while at < to:
        near = ranks[at - NEAR : at + NEAR + 1]
        step = near.index(min(near)) - NEAR
        if step == 0:
            found.append(at + 1)
        # Words up to the least one ahead, or in reach of the least one behind, are not the least.
        at += step if step > 0 else step + NEAR + 1
    if size <= PIECE:
        return found
    whole: list[int] = []
    begin = 0
    for end in [*found, size]:
        while end - begin > PIECE:
            begin = min(range(begin + NEAR, begin + PIECE), key=lambda i: (ranks[i], -i)) + 1
            whole.append(begin)
        if end < size:
            whole.append(end)
        begin = end
    return whole


def sentences(text: bytes | None) -> list[tuple[bytes, list[bytes]]]:
    """The text cut into pieces that make it up again, each with its lower-cased words.

    A sentence ends at a full stop, exclamation or question mark before white space, or at a line
    break; the white space belongs to the piece before it, also at the beginning of a text.  Within a
    sentence the words themselves tell where it is cut.
    """
    if not text:
        return []
    found: list[tuple[bytes, list[bytes]]] = []
    begin = 0
    for end in [*[m.end() for m in END.finditer(text)], len(text)]:
        piece = text[begin:end]
        begin = end
        words = piece.lower().split()
        if not words:
            if piece and found:
                found[-1] = (found[-1][0] + piece, found[-1][1])
            elif piece:
                found.append((piece, []))
            continue
        inner = cuts(words)
        if not inner:
            found.append((piece, words))
            continue
        tokens = WORD.findall(piece)
        i = 0
        for j in inner:
            found.append((b"".join(tokens[i:j]), words[i:j]))
            i = j
        found.append((b"".join(tokens[i:]), words[i:]))
    return found


def runs(found: list[tuple[bytes, list[bytes]]], least: int = SENTENCES, words: int = WORDS) -> Iterator[tuple[int, int, int]]:
    """(hash, first, after the last) of the shortest run from each piece, and of the shortest to each piece, that is long enough."""
    joined = [b" ".join(w) for _, w in found]
    counts = [len(w) for _, w in found]
    end, held = 0, 0
    for begin in range(len(found)):
        before = end
        while end < len(found) and (end - begin < least or held < words):
            held += counts[end]
            end += 1
        enough = end - begin >= least and held >= words
        # Where the end moves by several pieces, those between end a run from the piece before.
        if begin:
            for to in range(before + 1, end if enough else end + 1):
                yield _digest(joined[begin - 1 : to]), begin - 1, to
        if not enough:
            return
        yield _digest(joined[begin:end]), begin, end
        held -= counts[begin]


def _digest(parts: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"\n".join(parts)) - (1 << 63)


def own_first(found: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int | None, int, int]]:
    """The first run of each hash in a document; then, without hash, the stretches covered by its later runs.

    A line that a document repeats a thousand times is sent out once, and what follows in the document is
    known to be no first.
    """
    seen: set[int] = set()
    later: list[list[int]] = []
    for digest, begin, end in found:
        if digest not in seen:
            seen.add(digest)
            yield digest, begin, end
        elif later and begin <= later[-1][1]:
            later[-1][1] = max(later[-1][1], end)
        else:
            later.append([begin, end])
    for begin, end in later:
        yield None, begin, end


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` stored with packed texts, each row with a number of its own, its id, a digest and the pieces of its text, and its runs."""
    text = F.col(f"`{text_col}`").cast("string")
    numbered = docs.withColumn(text_col, text).withColumns({ROW: F.monotonically_increasing_id(), ID: F.col(f"`{id_col}`").cast("long"), DIGEST: F.xxhash64(text)})
    at = docs.columns.index(text_col)
    kind = pa.struct([("hash", pa.int64()), ("span", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in slices(batches):
            total, ends, packed = [], [0], []
            out: list[list[int | None]] = [[], []]
            for text in part.column(at).cast(pa.large_binary()).to_pylist():
                packed.append(None if text is None else pack(text))
                pieces = sentences(text)
                total.append(len(pieces))
                for digest, begin, end in own_first(runs(pieces, least, words)):
                    out[0].append(digest)
                    out[1].append(begin << 32 | end)
                ends.append(len(out[0]))
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], fields=list(kind))
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            columns = [*part.columns[:at], pa.array(packed, pa.binary()), *part.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), held], [*part.schema.names, TOTAL, RUNS])

    fields = [StructField(f.name, BinaryType()) if f.name == text_col else f for f in numbered.schema.fields]
    schema = StructType(fields).add(TOTAL, "long").add(RUNS, ArrayType(StructType().add("hash", "long").add("span", "long")))
    return settle(numbered.mapInArrow(run, schema))


def repeats(marked: DataFrame) -> DataFrame:
    """(row, spans array of begin << 32 | end) of rows with runs that are not the first of their kind, in order of id and position.

    Null ids come last, in order of their texts' digests; rows that are alike in these are ordered by their
    number.  Runs carry their place, so they meet by hash once, at every size.  Hashes that may hold over a
    share of 1 / HOT of all runs, HOT at most, are settled by partial sums instead, so that no task gets all
    of their runs.
    """
    none = F.col(ID).isNull()
    runs_of = marked.select(none.alias("none"), F.coalesce(ID, DIGEST).alias("id"), F.col(ROW).alias("row"), F.explode(RUNS).alias("run"))
    spans = runs_of.select("run.*", "none", "id", "row")
    met = spans.where("hash is not null")
    place = F.struct("none", "id", "row", "span")
    common = met.select("hash").stat.freqItems(["hash"], 1 / HOT).first()[0]
    hot = F.col("hash").isin(*common) if common else F.lit(False)
    firsts = F.broadcast(settle(met.where(hot).groupBy("hash").agg(F.min(place).alias("first"))))
    again = met.where(hot).join(firsts, "hash").where("row <> first.row or span <> first.span")
    ranked = met.where(~hot).withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("none", "id", "row", "span")))
    found = [part.select("row", "span") for part in (again, ranked.where("rank > 1"), spans.where("hash is null"))]
    # At most two runs begin at most pieces, so a row has not many more spans than pieces.
    return found[0].unionAll(found[1]).unionAll(found[2]).groupBy("row").agg(F.collect_set("span").alias("spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with the repeated pieces cut from the text, and n_sentences, n_removed (both in pieces) of each row.

    Of equal runs the one with the smallest (id, stored row, position) stays; null ids come last, in order of
    their texts' digests.  Every row is a document of its own, also where ids are null or repeat: of rows that
    are equal in id and text one stays whole.  A null text stays null and an empty one empty, with 0 and 0.
    Texts may be of any length; a text all of whose pieces are repeated becomes empty.  Columns named
    n_sentences and n_removed are replaced, other columns are kept.
    """
    own = ["n_sentences", "n_removed"]
    source = docs.drop(*own)
    names = source.columns
    marked = mark(source, id_col, text_col, least, words)
    found = repeats(marked).withColumnsRenamed({"row": "_cut_row", "spans": "_cut_spans"})
    rows = marked.join(found, F.col(ROW) == F.col("_cut_row"), "left").select(*[F.col(f"`{c}`") for c in names], TOTAL, "_cut_spans")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for part in slices(batches):
            gone = [0] * part.num_rows
            columns = list(part.columns[:-1])
            texts = [None if x is None else unpack(x) for x in columns[at].to_pylist()]
            for i, held in enumerate(part.column(part.num_columns - 1).to_pylist()):
                if held:
                    pieces = sentences(texts[i])
                    covered = {k for s in held for k in range(s >> 32, s & 0xFFFFFFFF)}
                    texts[i] = b"".join(p for k, (p, _) in enumerate(pieces) if k not in covered)
                    gone[i] = len(covered)
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], [*names, *own])

    fields = [StructField(f.name, StringType()) if f.name == text_col else f for f in rows.schema.fields[:-2]]
    return rows.mapInArrow(run, StructType(fields).add("n_sentences", "long").add("n_removed", "long"))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated sentences cut, in the columns they have; the length column, if any, counts the new text.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and other columns are as in ``dedup``; a
    length stays as it is, null too, where nothing is cut.
    """
    cut = dedup(docs, id_col, text_col)
    if length_col in docs.columns:
        fresh = F.when(F.col("n_removed") > 0, F.length(text_col)).otherwise(F.col(length_col))
        cut = cut.withColumn(length_col, fresh.cast(docs.schema[length_col].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])
