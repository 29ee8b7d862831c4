"""M1: the catalog over ``documents``; formats, files and dates are rules on doc_id, manual verdicts come from ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog
from ..sources import tables

#: How the driver's documents stand in for a catalog, as SQL that both engines read.
FORMAT = "CASE WHEN doc_id % 97 = 0 THEN 'hwp' WHEN doc_id % 89 = 0 THEN 'image' WHEN doc_id % 83 = 0 THEN 'html' WHEN doc_id % 79 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 THEN 'pdf' WHEN doc_id % 5 = 1 THEN 'pmc' WHEN doc_id % 5 = 2 THEN 'kdca' ELSE 'web' END"
COLUMNS = {
    "format": FORMAT,
    "is_manual": "doc_id % 7 = 0",
    "n_pages": "1 + doc_id % 40",
    "n_empty": "CASE WHEN doc_id % 3 = 0 THEN doc_id % (1 + doc_id % 40) + CASE WHEN doc_id % 30 = 0 THEN 1 ELSE 0 END ELSE 0 END",
    "n_ocr": "doc_id % 2",
    "error": "CASE WHEN doc_id % 71 = 0 THEN 'broken file' END",
    "source_name": "concat('Source ', source)",
    "method": "CASE WHEN source > 'src5' THEN 'manual' ELSE 'code' END",
}
_BASE = "SELECT d.doc_id, d.source, d.n_chars, sha256(d.read) AS sha256, " + ", ".join(f"{how} AS {name}" for name, how in COLUMNS.items()).replace("doc_id", "d.doc_id") + " FROM (SELECT *, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE text END AS read FROM documents) d"


def _catalog(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", "source", "n_chars", F.sha2(F.when(F.col("doc_id") % 50 != 7, F.col("text")).cast("binary"), 256).alias("sha256"), *[F.expr(how).alias(name) for name, how in COLUMNS.items()])


def catalog_exact_dup(spark, d):
    """C5."""
    return catalog.with_exact_dup(_catalog(spark, d)).select("doc_id", "sha256", "dup_of")


def catalog_auto_verdict(spark, d):
    """C4."""
    rows = catalog.with_exact_dup(_catalog(spark, d)).withColumn("v", catalog.auto_verdict())
    return rows.select("doc_id", "format", F.col("v.verdict").alias("verdict"), F.col("v.reason").alias("reason"))


def _judged(spark, d):
    rows = catalog.with_exact_dup(_catalog(spark, d)).withColumn("auto", catalog.auto_verdict()["verdict"])
    labels = tables.table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "exclude").when((F.col("quality") == 1) & (F.col("doc_id") % 4 == 0), "use").otherwise("").alias("manual"))
    return rows.join(labels, "doc_id", "left").withColumn("verdict", catalog.final_verdict(F.col("manual"), F.col("auto")))


def catalog_final_verdict(spark, d):
    """C6."""
    return _judged(spark, d).select("doc_id", "auto", "manual", "verdict")


def catalog_source_summary_total(spark, d):
    """C7."""
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")), "yyyy-MM-dd")
    return catalog.source_summary(_judged(spark, d).withColumn("collected_on", day))


def catalog_upsert_status(spark, d):
    """Documents of ids not divisible by 10 are known; those not divisible by 11 come in, every 6th changed."""
    docs = tables.table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("manual://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    known = docs.filter("doc_id % 10 <> 0").select("url", F.col("doc_id").cast("string").alias("doc_id"), "sha256", F.lit("2026-01-01").alias("collected_on"), F.when(F.col("doc_id") % 9 == 0, "use").otherwise("").alias("manual_verdict"), F.when(F.col("doc_id") % 8 == 0, "seen").otherwise("").alias("note"), F.lit("").alias("license"))
    fresh = docs.filter("doc_id % 11 <> 0").select("url", F.when(F.col("doc_id") % 6 == 0, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"), F.lit("2026-02-01").alias("collected_on"), F.lit("cc").alias("license"))
    return catalog.upsert(known, fresh)


def catalog_next_id(spark, d):
    """Ids divisible by 3 are known as source-NNN."""
    docs = tables.table(spark, d, "documents").select("doc_id", "source", F.format_string("u%09d", "doc_id").alias("url"))
    known = docs.filter("doc_id % 3 = 0").select("source", F.concat("source", F.lit("-"), F.lpad((F.col("doc_id") % 900).cast("string"), 3, "0")).alias("doc_id"))
    return catalog.next_ids(known, docs.filter("doc_id % 3 <> 0").select("source", "url"))


def doc_type_rule(spark, d):
    """C10."""
    return tables.table(spark, d, "documents").select("doc_id", catalog.doc_type(F.col("source"), ("src1", "src7")).alias("doc_type"))


def display_title(spark, d):
    """C9."""
    rows = tables.table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 11 = 0 THEN NULL ELSE substring(text, 1, 20) END AS post", "concat(source, '_file_', doc_id, '.v1.pdf') AS file", "doc_id % 7 = 0 AS manual")
    return rows.select("doc_id", catalog.display_title(F.col("post"), F.col("file"), F.col("manual")).alias("title"))


def catalog_used(spark, d):
    """C8."""
    return catalog.used(_judged(spark, d).select("doc_id", F.coalesce("manual", F.lit("")).alias("verdict_manual"), F.col("auto").alias("verdict_auto"))).select("doc_id")


def display_title_by_source(spark, d):
    """C9 with journals and the portal."""
    rows = tables.table(spark, d, "documents").selectExpr("doc_id", "source", "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 11 = 0 THEN NULL ELSE concat(' post ', doc_id) END AS post", "concat(source, '_file_', doc_id, '.v1.pdf') AS file", "doc_id % 7 = 0 AS manual", f"{FORMAT} AS format")
    title = catalog.display_title(F.col("post"), F.col("file"), F.col("manual"), F.col("format"), F.col("source"), F.concat(F.lit("Journal "), "source"), ("src3", "src1"), "portal: ")
    return rows.select("doc_id", title.alias("title"))


def text_char_count(spark, d):
    """X7."""
    return tables.table(spark, d, "documents").select("doc_id", text.count_chars(F.col("text")).cast("long").alias("n"))


def text_letter_share(spark, d):
    """X8, on texts of which every third gets some Hangul syllables."""
    mixed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.repeat(F.lit("가나"), (F.col("doc_id") % 600).cast("int")))).otherwise(F.col("text"))
    return tables.table(spark, d, "documents").select("doc_id", F.round(text.letter_share(mixed), 6).alias("share"), text.language_of(mixed).alias("lang"))


def url_page_expand(spark, d):
    """URLs of ``pages`` with a page range made of page_id."""
    rows = tables.table(spark, d, "pages").selectExpr(
        "page_id",
        "CASE WHEN page_id % 4 = 0 THEN url ELSE concat(url, '&p={page}') END AS url",
        "CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '1~3' WHEN 2 THEN '2-4' WHEN 3 THEN '0:2' WHEN 4 THEN '1월 3일' ELSE CASE WHEN page_id % 12 = 5 THEN 'x' ELSE ' 5 ' END END AS page_range",
    )
    return catalog.expand_urls(rows).select("page_id", "url", "problem")


def url_site_key(spark, d):
    """S8."""
    return tables.table(spark, d, "pages").select("page_id", text.site_key(F.col("url")).alias("site"))


QUERIES = {f.__name__: f for f in (catalog_exact_dup, catalog_auto_verdict, catalog_final_verdict, catalog_source_summary_total, catalog_upsert_status, catalog_next_id, doc_type_rule, display_title, catalog_used, display_title_by_source, text_char_count, text_letter_share, url_page_expand, url_site_key)}

_DUP = f"""
WITH base AS ({_BASE}),
judged AS (SELECT *, CASE WHEN sha256 IS NULL THEN doc_id ELSE first_value(doc_id) OVER (PARTITION BY sha256 ORDER BY is_manual, doc_id) END AS first_id FROM base),
verdicts AS (SELECT *, CASE WHEN first_id <> doc_id THEN first_id END AS dup_of,
  CASE WHEN first_id <> doc_id THEN ['exclude', 'exact duplicate: ' || first_id]
    WHEN format = 'hwp' THEN ['hold', 'needs conversion'] WHEN format = 'html' THEN ['exclude', 'a web page instead of a file']
    WHEN format = 'image' THEN ['exclude', 'an image instead of a file'] WHEN format = 'unknown' THEN ['hold', 'unknown format']
    WHEN error IS NOT NULL THEN ['exclude', error] WHEN format = 'web' AND n_chars < 200 THEN ['exclude', 'hardly any text']
    WHEN format = 'kdca' AND n_chars < 200 THEN ['exclude', 'title only'] WHEN format = 'pmc' AND n_chars < 1500 THEN ['exclude', 'abstract only']
    WHEN format = 'pdf' AND n_empty * 10 >= n_pages * 9 THEN ['exclude', 'no text layer: ' || n_empty || '/' || n_pages]
    WHEN format = 'pdf' AND n_empty > 0 AND n_ocr > 0 THEN ['use', 'recognised pages: ' || n_ocr]
    WHEN format = 'pdf' AND n_empty > 0 THEN ['use', 'empty pages: ' || n_empty] ELSE ['use', ''] END AS v FROM judged),
final AS (SELECT *, v[1] AS auto, coalesce(nullif(manual, ''), v[1]) AS verdict FROM (
  SELECT verdicts.*, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'exclude' WHEN quality = 1 AND l.doc_id % 4 = 0 THEN 'use' ELSE '' END AS manual
  FROM verdicts LEFT JOIN labels l ON verdicts.doc_id = l.doc_id))
"""
_UPSERT_BASE = "SELECT doc_id, 'manual://' || source || '/' || doc_id AS url, sha256(text) AS h FROM documents"
_SPACE = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ORACLE = {
    "catalog_exact_dup": _DUP + "SELECT doc_id, sha256, dup_of FROM verdicts",
    "catalog_auto_verdict": _DUP + "SELECT doc_id, format, v[1] AS verdict, v[2] AS reason FROM verdicts",
    "catalog_final_verdict": _DUP + "SELECT doc_id, auto, manual, verdict FROM final",
    "catalog_source_summary_total": _DUP
    + """SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, CASE WHEN grouping(source) = 1 THEN '' ELSE min(source_name) END AS source_name, CASE WHEN grouping(source) = 1 THEN '' ELSE min(method) END AS method, count(*) AS n_docs, count_if(verdict = 'use')::BIGINT AS n_use,
  count_if(verdict = 'exclude')::BIGINT AS n_exclude, count_if(verdict = 'hold')::BIGINT AS n_hold,
  coalesce(sum(CASE WHEN verdict = 'use' THEN n_chars END), 0)::BIGINT AS used_chars,
  max(strftime(DATE '2026-01-01' + (doc_id % 200)::INT, '%Y-%m-%d')) AS last_on
FROM final GROUP BY ROLLUP (source)""",
    "catalog_upsert_status": f"""
WITH docs AS ({_UPSERT_BASE}),
s AS (SELECT url, doc_id::VARCHAR AS doc_id, h, CASE WHEN doc_id % 9 = 0 THEN 'use' ELSE '' END AS mv, CASE WHEN doc_id % 8 = 0 THEN 'seen' ELSE '' END AS note FROM docs WHERE doc_id % 10 <> 0),
i AS (SELECT url, CASE WHEN doc_id % 6 = 0 THEN reverse(h) ELSE h END AS h FROM docs WHERE doc_id % 11 <> 0)
SELECT coalesce(s.url, i.url) AS url, s.doc_id, coalesce(i.h, s.h) AS sha256, CASE WHEN i.url IS NULL THEN '2026-01-01' ELSE '2026-02-01' END AS collected_on,
  coalesce(mv, '') AS manual_verdict,
  CASE WHEN s.h <> i.h THEN CASE WHEN note <> '' THEN note || ' | ' ELSE '' END || 'changed 2026-02-01 (before: ' || s.doc_id || '_2026-01-01)' ELSE coalesce(note, '') END AS note,
  CASE WHEN i.url IS NULL THEN NULL ELSE 'cc' END AS license,
  CASE WHEN i.url IS NULL THEN 'kept' WHEN s.url IS NULL THEN 'new' WHEN s.h = i.h THEN 'unchanged' ELSE 'updated' END AS status
FROM s FULL JOIN i ON s.url = i.url""",
    "catalog_next_id": """
WITH top AS (SELECT source, max(doc_id % 900) AS top FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
fresh AS (SELECT source, printf('u%09d', doc_id) AS url, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id % 3 <> 0)
SELECT fresh.source, url, fresh.source || '-' || CASE WHEN coalesce(top, 0) + n < 1000 THEN lpad((coalesce(top, 0) + n)::VARCHAR, 3, '0') ELSE (coalesce(top, 0) + n)::VARCHAR END AS doc_id
FROM fresh LEFT JOIN top ON fresh.source = top.source""",
    "doc_type_rule": "SELECT doc_id, CASE WHEN starts_with(source, 'src1') OR starts_with(source, 'src7') THEN 'academic' ELSE 'public' END AS doc_type FROM documents",
    "display_title": """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(source || '_file_' || doc_id || '.v1', '_', ' ') WHEN doc_id % 3 = 0 OR doc_id % 11 = 0 OR substring(text, 1, 20) = '' THEN source || '_file_' || doc_id || '.v1.pdf' ELSE regexp_replace(substring(text, 1, 20), '^\\s+|\\s+$', '', 'g') END AS title FROM documents""",
    "catalog_used": _DUP + "SELECT doc_id FROM final WHERE verdict = 'use'",
    "display_title_by_source": f"""
SELECT doc_id, trim(CASE WHEN f = 'kdca' THEN 'portal: ' ELSE '' END || CASE WHEN f = 'pdf' AND (starts_with(source, 'src3') OR starts_with(source, 'src1')) THEN 'Journal ' || source
  WHEN doc_id % 7 = 0 THEN replace(source || '_file_' || doc_id || '.v1', '_', ' ') WHEN doc_id % 3 = 0 OR doc_id % 11 = 0 THEN source || '_file_' || doc_id || '.v1.pdf' ELSE ' post ' || doc_id END) AS title
FROM (SELECT *, {FORMAT} AS f FROM documents)""",
    "text_char_count": f"SELECT doc_id, length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS n FROM documents",
    "text_letter_share": """
SELECT doc_id, round(h / nullif(h + l, 0), 6) AS share, CASE WHEN h + l = 0 THEN '' WHEN h / (h + l) >= 0.3 THEN 'ko' ELSE 'en' END AS lang FROM (
  SELECT doc_id, length(regexp_replace(t, '[^가-힣]+', '', 'g'))::DOUBLE AS h, length(regexp_replace(t, '[^A-Za-z]+', '', 'g'))::DOUBLE AS l FROM (
    SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN repeat('가나', (doc_id % 600)::INT) ELSE '' END AS t FROM documents))""",
    "url_page_expand": """
SELECT page_id, url, NULL::VARCHAR AS problem FROM pages WHERE page_id % 4 = 0
UNION ALL
SELECT page_id, url || '&p={page}', 'unreadable page range: x' FROM pages WHERE page_id % 4 <> 0 AND page_id % 12 = 5
UNION ALL
SELECT page_id, url || '&p=' || p, NULL FROM (SELECT *, unnest(CASE page_id % 6 WHEN 1 THEN [1, 2, 3] WHEN 2 THEN [2, 3, 4] WHEN 3 THEN [1, 2] WHEN 4 THEN [1, 2, 3] WHEN 5 THEN CASE WHEN page_id % 12 = 5 THEN [] ELSE [5] END ELSE [] END) AS p FROM pages WHERE page_id % 4 <> 0)""",
    "url_site_key": "SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS site FROM pages",
}
