"""SentencePiece operator against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from gridcast.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(PATH)


ODD = ["", " ", "  ", "   a", "a" * 5000, "ab" * 3000, " " * 33 + "x", "\n\n", "<s></s><unk>", "<0x0A>", "▁", "a▁b  ▁", "日本語テキスト" * 50]
ODD += ["é ß 文字 🙂", "\x00a\x00", "�", "aaa aaaa aaaaa", "\t\tx", "x" + " " * 1000 + "y", " " * 3 + "\n" + " " * 18, "word " * 20_000, "𒀀𒀁" * 9]
ODD += [" " * n for n in range(3, 70)] + [" " * n + "of" for n in range(3, 70)]


def test_ids_and_text_equal_the_library(codec, library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab cde fghtin rs   \n.,é文0▁🙂") for _ in range(rng.randint(1, 120))) for _ in range(4000)]
    for text, got in zip(texts, codec.encode(texts), strict=True):
        want = library.encode(text)
        assert got.tolist() == want, text[:50]
        assert codec.decode(want) == library.decode(want)


def test_long_stretches_equal_rounds(codec, library, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("therin") for _ in range(600)) for _ in range(10)]
    assert codec.words(texts[0]) != []
    monkeypatch.setattr(pieces, "LONG", 8)
    short = pieces.Codec(PATH)
    assert [x.tolist() for x in short.encode(texts)] == [library.encode(t) for t in texts] == [x.tolist() for x in codec.encode(texts)]


def test_small_memo_changes_nothing(library):
    texts = [f"some words {i} of {i % 7} kinds, and more" for i in range(60)]
    small = pieces.Codec(PATH, entries=5)
    assert [x.tolist() for x in small.encode(texts)] == [library.encode(t) for t in texts]


def test_decoding_bytes_that_make_no_character(codec, library):
    byte = {b: int(codec.vocabulary.bytes_of[b]) for b in (0xE6, 0x96, 0x87, 0xFF, 0x41)}
    for ids in ([byte[0xE6], byte[0x96], byte[0x87]], [byte[0xFF], byte[0x41]], [1, byte[0x41], 2], [0], []):
        assert codec.decode(ids) == library.decode(ids)


def test_documents(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_tables(spark, odd_docs, library):
    encoded = pieces.encode(odd_docs)
    back = sorted(((r.doc_id is None, r.doc_id or 0), r.text) for r in pieces.decode(encoded).collect())
    want = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in odd_docs.collect())
    assert back == want
    assert pieces.encode(odd_docs.limit(0)).count() == pieces.round_trip(odd_docs.limit(0)).count() == 0
    null_ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(null_ids).collect()} == {1: None, 2: ""}
