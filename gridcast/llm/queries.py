"""Registered queries of the subpackage, by the operators' production settings, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import bpe, imatch, langid, licenses, mixing, near_vectors, ngram_join, pieces, quality_fm, sharding, spans, variants, whitening
from gridcast.llm.store import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Links by every pair of one label; closure along links by repeated joins.
_VECTOR_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS r FROM embeddings UNION SELECT l.v, reach.r FROM reach JOIN links l ON l.u = reach.u),
low AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""


@query("op1_near_vectors", _VECTOR_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"), 0.93)


@query("op6_byte_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    made = bpe.round_trip(table(spark, folder, "documents"))
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


_NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: list_aggregate(w[i:i+2], 'string_agg', ' '))) AS g
    FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT l.v, reach.r FROM reach JOIN links l ON l.u = reach.u),
low AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u),
k AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d JOIN low ON low.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.u = d.doc_id
"""


@query("op9_ngram_jaccard", _NGRAM_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"), 90, 100, 3)


@query("op2_sentence_spans")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return spans.dedup(table(spark, folder, "documents")).select("doc_id", "n_sentences", "n_removed", "text")


@query("op3_imatch")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(table(spark, folder, "documents"))


@query("op7_quality_fm")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    machine = quality_fm.learn(docs, table(spark, folder, "labels"))
    scored = quality_fm.score(docs, machine, threshold=0.3)
    return scored.select("doc_id", quality_fm.held_out().alias("held_out"), "score", "predicted")


@query("op8_kneser_ney_language")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_notices", F.to_json("notices").alias("notices"))


def mixing_sql(source: str, share: float, epochs: int, seed: int, columns: str) -> str:
    """The mix in SQL: capacities from below, budgets from above, whole epochs and the beginning of one more."""
    case = lambda col, named: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in named.items()) + f" ELSE {mixing.OTHER} END"

    def level(name: str, above: list[str], col: str, weight: str, parent: str) -> str:
        group = ", ".join(above) or "0"
        keys = ", ".join([*above, col])
        using = f"JOIN {parent} USING ({', '.join(above)})" if above else f"CROSS JOIN {parent}"
        return f"""
{name}_n AS (SELECT {keys}, cap, parent_budget, {weight} AS w FROM (SELECT {keys}, sum(cap) AS cap FROM leaf GROUP BY {keys}) {using}),
{name}_a AS (SELECT *, (parent_budget - coalesce(sum(cap) OVER (PARTITION BY {group} ORDER BY cap / w, {col} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (PARTITION BY {group} ORDER BY cap / w, {col} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM {name}_n),
{name} AS (SELECT {keys}, greatest(0.0, least(CAST(cap AS DOUBLE), w * max(lvl) OVER (PARTITION BY {group}))) AS parent_budget FROM {name}_a)"""

    return rf"""
WITH r AS (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(source, '')), 1, 2) AS INTEGER) % 4 AS VARCHAR) AS domain,
  coalesce(lang, '') AS language, coalesce(source, '') AS origin,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS tokens FROM {source}),
leaf AS (SELECT domain, language, origin, sum(tokens) AS tokens, sum(tokens) * {epochs} AS cap FROM r GROUP BY ALL),
root AS (SELECT least(sum(tokens) * CAST({share} AS DOUBLE), CAST(sum(cap) AS DOUBLE)) AS parent_budget FROM leaf),
{level("d", [], "domain", case("domain", mixing.DOMAINS), "root")},
{level("l", ["domain"], "language", case("language", mixing.LANGUAGES), "d")},
{level("o", ["domain", "language"], "origin", "1.0", "l")},
plan AS (SELECT domain, language, origin, tokens AS supply, CAST(floor(parent_budget + 1e-6) AS BIGINT) AS quota FROM o JOIN leaf USING (domain, language, origin)),
e AS (SELECT *, CASE WHEN supply > 0 THEN CAST(quota // supply AS BIGINT) ELSE 0 END AS whole FROM plan),
k AS (SELECT r.*, whole, quota - whole * supply AS rest, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM r JOIN e USING (domain, language, origin)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY digest RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
  - sum(tokens) OVER (PARTITION BY domain, language, origin, digest) AS start FROM k),
c AS (SELECT *, CAST(whole + CASE WHEN rest > 0 AND start < rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM s)
SELECT {columns} FROM c WHERE copies > 0
"""


_MIX_COLUMNS = "doc_id, domain, lang, source, tokens AS n_words, copies"


@query("op5_source_mix", mixing_sql("documents", 0.6, 2, 17, _MIX_COLUMNS))
def op5(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), share=0.6, epochs=2, seed=17)
    return mixed.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_tokens").alias("n_words"), F.col("_copies").alias("copies"))


@query("op10_lookup_sharding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    sharding.write(docs, path)
    placed = sharding.read(spark, path, docs.schema)
    return placed.select("doc_id", "slot", "shard", F.octet_length("text").cast("long").alias("n_bytes"))


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return whitening.whiten(vectors, whitening.learn(vectors))


@query("op12_spelling_variants")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group(variants.word_counts(table(spark, folder, "documents"), damage=199))


@query("op13_sentencepiece")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"))
