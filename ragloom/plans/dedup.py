"""M2: near-duplicates over ``documents``, language by language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from ..sources import tables
from ..sources.sinks import checkpointed


def _docs(spark, d):
    return tables.table(spark, d, "documents")


def dedup_shingle_count(spark, d):
    """D1."""
    return dedup.shingle_counts(_docs(spark, d))


def dedup_jaccard_pairs(spark, d):
    """Pairs of classes of equal shingle sets, similarity 0.6 or more."""
    return dedup.jaccard_pairs(_docs(spark, d)).select("a", "b", F.col("inter").cast("long").alias("inter"), F.round("jaccard", 6).alias("jaccard"))


def dedup_near_pairs(spark, d):
    """For each class, how many others are alike but not the same, and the most alike one."""
    pairs = dedup.jaccard_pairs(_docs(spark, d)).filter(F.col("jaccard") < dedup.SAME)
    both = pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("other"), "jaccard").unionByName(pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("other"), "jaccard"))
    return both.groupBy("doc_id").agg(F.count("*").alias("n_similar"), F.max(F.struct("jaccard", (-F.col("other")).alias("o"))).alias("best")).select("doc_id", "n_similar", (-F.col("best.o")).alias("nearest"), F.round("best.jaccard", 6).alias("jaccard"))


def dedup_class_members(spark, d):
    """Which class each document is in."""
    return dedup.class_members(_docs(spark, d))


def dedup_content_exclusion(spark, d):
    """D3 over class representatives."""
    return dedup.copies_excluded(_docs(spark, d))


def dedup_notes(spark, d):
    """D4 over class representatives: verdicts by id, reasons after the content check, and notes on similar ones."""
    docs = _docs(spark, d)
    members, pairs = dedup.classes_and_pairs(docs)
    live = checkpointed(members.filter("doc_id = class_id").selectExpr("doc_id", "CASE WHEN doc_id % 9 = 0 THEN 'hold' ELSE 'use' END AS verdict", "CASE WHEN doc_id % 4 = 0 THEN 'seen' ELSE '' END AS reason"))
    return dedup.similar_notes(live, dedup.content_exclusion(live.select("doc_id"), pairs), pairs).select("doc_id", "verdict", F.md5("reason").alias("h"))


QUERIES = {f.__name__: f for f in (dedup_shingle_count, dedup_jaccard_pairs, dedup_near_pairs, dedup_class_members, dedup_content_exclusion, dedup_notes)}
_SPACE = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SETS = f"""
WITH RECURSIVE bare AS (SELECT doc_id, lang, regexp_replace(text, '{_SPACE}+', '', 'g') AS t FROM documents),
grams AS (SELECT DISTINCT doc_id, lang, substring(t, i, 10) AS g FROM (SELECT *, unnest(range(1, length(t) - 8)) AS i FROM bare WHERE length(t) >= 10)),
sizes AS (SELECT doc_id, lang, count(*) AS n, sum(hash(g)::HUGEINT) AS key FROM grams GROUP BY 1, 2),
members AS (SELECT doc_id, lang, n, min(doc_id) OVER (PARTITION BY lang, n, key) AS class_id FROM sizes),
rep AS (SELECT doc_id, lang, n FROM members WHERE doc_id = class_id),
own AS (SELECT grams.* FROM grams JOIN rep USING (doc_id)),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM own x JOIN own y ON x.lang = y.lang AND x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b, inter, inter / (p.n + q.n - inter) AS jaccard FROM shared JOIN rep p ON a = p.doc_id JOIN rep q ON b = q.doc_id WHERE inter >= 0.6 * (p.n + q.n - inter))
"""
_WALK = """, same AS MATERIALIZED (SELECT a, b FROM pairs WHERE jaccard >= 0.98),
partners AS MATERIALIZED (SELECT row_number() OVER (ORDER BY b) AS k, b, list(a ORDER BY a) AS earlier FROM same GROUP BY b),
walk(k, doc_id, excluded_by, gone) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT p.k, p.b, list_filter(p.earlier, lambda e: NOT list_contains(walk.gone, e))[1],
    CASE WHEN list_filter(p.earlier, lambda e: NOT list_contains(walk.gone, e))[1] IS NULL THEN walk.gone ELSE list_append(walk.gone, p.b) END
  FROM walk JOIN partners p ON p.k = walk.k + 1)"""
ORACLE = {
    "dedup_shingle_count": _SETS + "SELECT bare.doc_id, coalesce(n, 0)::BIGINT AS n FROM bare LEFT JOIN sizes USING (doc_id)",
    "dedup_jaccard_pairs": _SETS + "SELECT a, b, inter, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= 0.6",
    "dedup_class_members": _SETS + "SELECT doc_id, class_id FROM members",
    "dedup_near_pairs": _SETS
    + """, both_ways AS (SELECT a AS doc_id, b AS other, jaccard FROM pairs WHERE jaccard < 0.98 UNION ALL SELECT b, a, jaccard FROM pairs WHERE jaccard < 0.98)
SELECT doc_id, count(*) AS n_similar, first(other ORDER BY jaccard DESC, other) AS nearest, round(max(jaccard), 6) AS jaccard FROM both_ways GROUP BY 1""",
    "dedup_content_exclusion": _SETS + _WALK + " SELECT rep.doc_id, excluded_by FROM rep LEFT JOIN walk ON rep.doc_id = walk.doc_id",
    "dedup_notes": _SETS
    + _WALK
    + """, state AS (SELECT rep.doc_id, excluded_by, CASE WHEN rep.doc_id % 9 = 0 THEN 'hold' ELSE 'use' END AS verdict, CASE WHEN rep.doc_id % 4 = 0 THEN 'seen' ELSE '' END AS reason FROM rep LEFT JOIN walk ON rep.doc_id = walk.doc_id),
kept AS (SELECT a, b, jaccard FROM pairs JOIN state ON a = doc_id WHERE jaccard < 0.98 OR NOT (verdict = 'use' AND excluded_by IS NULL)),
notes AS (SELECT x, string_agg('similar: ' || y || ' ' || round_even(jaccard * 100, 0)::INT || '%', ' | ' ORDER BY y) AS n FROM (SELECT a AS x, b AS y, jaccard FROM kept UNION ALL SELECT b, a, jaccard FROM kept) GROUP BY 1)
SELECT doc_id, CASE WHEN excluded_by IS NOT NULL THEN 'exclude' ELSE verdict END AS verdict,
  md5(CASE WHEN excluded_by IS NOT NULL THEN 'content duplicate: ' || excluded_by WHEN verdict = 'use' THEN concat_ws(' | ', nullif(reason, ''), n) ELSE reason END) AS h
FROM state LEFT JOIN notes ON doc_id = x""",
}
