"""Queries of the subpackage: which of them have SQL, and what tests the others."""

import __spark_entry__ as entry_module
import corpus_pipeline
from gridcast.llm.queries import QUERIES, SQL

# Without SQL: compared with brute force, a tokenizer library or held-out rows in this folder.
TESTED = {
    "op2_sentence_spans",
    "op3_imatch",
    "op4_license_scan",
    "op6_byte_bpe",
    "op7_quality_fm",
    "op8_kneser_ney_language",
    "op10_lookup_sharding",
    "op11_whitening",
    "op12_spelling_variants",
    "op13_sentencepiece",
}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == TESTED
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert (corpus_pipeline.ORACLE_SQL is None) == ("pipeline" not in entry_module.oracle_sql())
