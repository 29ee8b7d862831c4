"""M0: vector search over ``embeddings`` joined to ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector
from ..sources import tables


def _scored(spark, d, limits):
    return vector.best_scores(tables.chunks(spark, d), tables.queries(spark, d), limits)


def _out(df):
    return df.select("query_id", "chunk_id", "doc", "doc_type", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_cosine_topk(spark, d):
    """V6: the 10 nearest chunks by the original form."""
    return vector.topk(_scored(spark, d, [vector.Limit("score_original", 10)]), 10, "score_original").select("query_id", "chunk_id", F.round("score_original", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_fused_topk(spark, d):
    """V7: the 10 nearest chunks by the better of two forms."""
    return _out(vector.topk(_scored(spark, d, [vector.Limit("score", 10)]), 10))


def vector_quota_topk(spark, d):
    """V8, V9 (flagship): k 10, 2 of a document, 5 public first, 1 of a public document."""
    return _out(vector.quota_topk(_scored(spark, d, vector.quota_limits())))


def vector_quota_academic(spark, d):
    """V8 with an academic quota: k 8, 3 academic, 2 of a document."""
    quotas = {"k": 8, "per_doc": 2, "academic": 3, "public": 2, "public_per_doc": None}
    return _out(vector.quota_topk(_scored(spark, d, vector.quota_limits(**quotas)), **quotas))


def vector_l2_normalise(spark, d):
    """V3: length of each vector before and after normalisation."""
    v = tables.table(spark, d, "embeddings")
    twice = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    unit = vector.l2_normalise(twice)
    return v.select("vec_id", F.round(F.sqrt(vector.dot(twice, twice)), 5).alias("norm_before"), F.round(F.sqrt(vector.dot(unit, unit)), 5).alias("norm_after"), F.round(unit[0], 5).alias("first"))


_SCORED = """
WITH chunks AS (
  SELECT e.vec_id AS chunk_id, d.source AS doc, e.embedding::DOUBLE[] AS v,
    CASE WHEN regexp_matches(d.source, '^src[0-6]$') THEN 'academic' ELSE 'public' END AS doc_type
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
queries AS (
  SELECT a.vec_id AS query_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0),
s0 AS (
  SELECT query_id, chunk_id, doc, doc_type, list_dot_product(v, a) AS original,
    greatest(list_dot_product(v, a), list_dot_product(v, b)) AS fused, FALSE AS picked
  FROM chunks, queries WHERE chunk_id NOT IN (query_id, query_id + 1))"""


def _stage(n: int, pool: str, by: str, target: str, cap: int | None) -> str:
    limit = f"place <= {cap} - used" if cap else "TRUE"
    return f""",
p{n} AS (SELECT *, ({pool}) AND NOT picked AS free, sum(picked::INT) OVER (PARTITION BY query_id, doc) AS used,
  sum(picked::INT) OVER (PARTITION BY query_id) AS have FROM s{n}),
q{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc, free ORDER BY {by} DESC, chunk_id) AS place FROM p{n}),
r{n} AS (SELECT *, free AND {limit} AS may FROM q{n}),
t{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id, may ORDER BY {by} DESC, chunk_id) AS turn FROM r{n}),
s{n + 1} AS (SELECT query_id, chunk_id, doc, doc_type, original, fused, picked OR (may AND turn <= {target} - have) AS picked FROM t{n})"""


def _ranked(n: int) -> str:
    return f"""
SELECT query_id, chunk_id, doc, doc_type, round(fused, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank
FROM s{n} WHERE picked"""


_TOP = """
SELECT {columns}, round({by}, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by} DESC, chunk_id) AS rank FROM s0) WHERE rank <= 10"""

QUERIES = {f.__name__: f for f in (vector_cosine_topk, vector_fused_topk, vector_quota_topk, vector_quota_academic, vector_l2_normalise)}
ORACLE = {
    "vector_cosine_topk": _SCORED + _TOP.format(columns="query_id, chunk_id", by="original"),
    "vector_fused_topk": _SCORED + _TOP.format(columns="query_id, chunk_id, doc, doc_type", by="fused"),
    "vector_quota_topk": _SCORED + _stage(0, "doc_type = 'public'", "original", "5", 1) + _stage(1, "TRUE", "fused", "10", 2) + _ranked(2),
    "vector_quota_academic": _SCORED + _stage(0, "doc_type = 'public'", "original", "2", 2) + _stage(1, "doc_type = 'academic'", "fused", "least(have + 3, 8)", 2) + _stage(2, "TRUE", "fused", "8", 2) + _ranked(3),
    "vector_l2_normalise": """
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS norm_before, round(sqrt(list_dot_product(u, u)), 5) AS norm_after, round(u[1], 5) AS first
FROM (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
  FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS v FROM embeddings))""",
}
