import public_tokenizers
import tiktoken

import corpus_pipeline
from gridcast.llm import bpe, quality_fm, spans
from tests.llm.test_operators import DATA, jaccard_brute, spans_brute


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stage(spark, given, DATA)
        kept[name] = docs.toPandas()
        docs = spark.createDataFrame(kept[name], docs.schema)
        before = given.toPandas()
        if stage is corpus_pipeline.quality:
            machine = quality_fm.learn(given, spark.read.parquet(f"{DATA}/labels.parquet"))
            good = {r.doc_id for r in quality_fm.score(given, machine).collect() if r.predicted}
            assert set(kept[name].doc_id) == good and 0 < len(good) < len(before)
        elif stage is corpus_pipeline.near_copies:
            want = jaccard_brute(list(zip(before.doc_id, before.text, strict=True)), 80, 100, 5)
            assert set(kept[name].doc_id) == {k for k, (_, root, _) in want.items() if root == k}
        elif stage is corpus_pipeline.passages:
            cover = spans_brute(list(zip(before.doc_id, before.text, strict=True)))
            text = dict(zip(kept[name].doc_id, kept[name].text, strict=True))
            for key, whole in zip(before.doc_id, before.text, strict=True):
                pieces = spans.sentences(whole.encode())
                assert text[key] == b"".join(p for i, (p, _) in enumerate(pieces) if i not in cover[key]).decode()
        elif stage is corpus_pipeline.mixture:
            assert set(kept[name].doc_id) < set(before.doc_id) and kept[name].doc_id.is_unique
            words = sum(len(t.encode().split()) for t in before.text)
            chosen = sum(len(t.encode().split()) for t in kept[name].text)
            # The share is 0.6; each leaf may go over it by a part of one document, or fall short of its words.
            assert 0.5 * words < chosen < 0.75 * words
        else:
            ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            size = {k: len(library.encode_ordinary(t)) for k, t in zip(before.doc_id, before.text, strict=True)}
            assert dict(zip(kept[name].doc_id, kept[name].n_tokens, strict=True)) == size
