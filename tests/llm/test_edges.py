"""Odd tables at the entry points that have no other test of them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridcast.llm import bpe, mixing, quality_fm, spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def odd(odd_docs):
    return odd_docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_decoding_what_is_null_or_repeated(spark):
    ids = bpe.encode(spark.createDataFrame([(1, "a b"), (None, "a b"), (1, "a b"), (2, None)], "doc_id long, text string"))
    empty = spark.createDataFrame([(5, None, "x")], "doc_id long, ids binary, text string")
    got = bpe.decode(ids.select("doc_id", "ids", F.lit("clash").alias("text")).unionByName(empty))
    assert rows(got, "doc_id", "text") == sorted([(1, "a b"), (None, "a b"), (1, "a b"), (2, ""), (5, None)], key=repr)
    assert bpe.decode(ids.limit(0)).collect() == []


def test_repeated_rows_of_a_mix(spark):
    kind = "doc_id long, text string, _domain string, _tokens long, _copies long"
    mixed = spark.createDataFrame([(1, None, "a", 0, 2), (None, "x", "b", 1, 1), (3, "y", "b", 1, 0), (4, "z", "b", 1, None)], kind)
    assert rows(mixing.repeated(mixed), "doc_id", "text") == sorted([(1, None), (1, None), (None, "x")], key=repr)


def test_documents_keep_their_rows_and_columns(odd):
    cut = spans.dedup_documents(odd)
    assert cut.columns == COLUMNS and rows(cut, "doc_id") == rows(odd, "doc_id")
    lost = {r.doc_id for r in cut.collect() if r.n_chars is not None and r.n_chars != len(r.text)}
    assert lost == set()
    # Of the two equal long texts the one with the smaller id stays whole.
    sizes = {r.doc_id: r.n_chars for r in cut.where("doc_id in (4, 5)").collect()}
    assert sizes[4] > 100_000 and sizes[5] < sizes[4]


def test_an_unfitted_machine_keeps_or_drops_all_alike(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_fm.keep_good(odd, quality_fm.learn(odd, none), threshold=0.0)
    assert kept.columns == COLUMNS and rows(kept, "doc_id") == rows(odd, "doc_id")


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_tables(spark, odd, tmp_path, place):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (8, 0, None), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    _, stage = corpus_pipeline.STAGES[place]
    last = place == len(corpus_pipeline.STAGES) - 1
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, str(tmp_path))
        assert last or out.columns == COLUMNS
        found = {r.doc_id for r in out.collect()}
        assert found <= {r.doc_id for r in docs.collect()}
        if corpus_pipeline.STAGES[place][0] in ("substring dedup", "byte-level BPE"):
            assert rows(out, "doc_id") == rows(docs, "doc_id")
