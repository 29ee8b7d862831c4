"""What may be fetched and when, over the sites of ``pages``, and encodings, over the texts of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import site_key
from ..operators import acquire, crawl, recognise
from ..sources import tables

AGENT = "RagBot/1.0 (+contact)"
#: Robots files that sites have by the first digit of their hash: status and body.
FILES = (
    (404, None),
    (403, "User-agent: *\nDisallow:\n"),
    (None, None),
    (200, "# made\nUser-agent: *\nDisallow: /\n\nUser-agent: other\nuser-agent: ragbot # us\nAllow: /%65n/1\nDisallow: /en\nDisallow: /fr/8\nCrawl-delay: 3\n"),
    (200, "Disallow: /none\nUser-agent: *\nCrawl-delay: 2\nDisallow:\nDisallow: /\n\nUser-agent: nobody\nDisallow: /x\n"),
)


def _allowed(spark, d):
    pages = tables.table(spark, d, "pages").select("page_id", "url").filter("url is not null")
    sites = pages.select(site_key(F.col("url")).alias("site")).distinct()
    kind = (F.conv(F.substring(F.md5("site"), 1, 1), 16, 10).cast("int") % len(FILES)).cast("int")
    of = lambda k, type_: F.element_at(F.array(*[F.lit(f[k]).cast(type_) for f in FILES]), kind + 1)
    return crawl.robots_allowed(pages, sites.select("site", of(0, "int").alias("status"), of(1, "string").alias("body")), AGENT)


def robots_allowed(spark, d):
    """Which pages may be fetched, and the delay that their site asks for."""
    return _allowed(spark, d).select("page_id", "allowed", F.col("delay").cast("long").alias("delay"))


def request_schedule(spark, d):
    """When each page that may be fetched is fetched, if page after page is ready a quarter of a second after the last, and some sooner."""
    gap = acquire.request_gap(F.lit(1), F.col("delay"), F.when(F.col("site").endswith(".org"), 2))
    ready = F.col("page_id") / 4 - F.when(F.col("page_id") % 5 == 0, 30).otherwise(0)
    requests = _allowed(spark, d).filter("allowed").select(F.col("page_id").alias("request_id"), "site", ready.alias("ready"), gap.cast("double").alias("gap"))
    return crawl.request_schedule(requests, 60).select("request_id", "gap", F.round("start", 3).alias("start"))


def text_encodings(spark, d):
    """Texts in UTF-8, in Latin-1 and in UTF-16 with a mark, none of them with a stated encoding."""
    docs = tables.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = F.regexp_replace("text", "[^\\x00-\\xFF]", "?")
    content = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode(plain, "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    files = docs.select(F.col("doc_id").alias("key"), content.alias("content"), F.lit(None).cast("string").alias("charset"))
    return crawl.decoded(files).select(F.col("key").alias("doc_id"), "encoding", F.md5(F.col("text").cast("binary")).alias("h"))


def _stand_in(image: bytes, resolution: int) -> str:
    """Reads an image that is its text; the fast one in small letters, and it fails where a text begins with E."""
    text = image.decode()
    if resolution == recognise.FAST and text.startswith("E"):
        raise ValueError("unreadable")
    return text.lower() if resolution == recognise.FAST else text


def staged_recognition(spark, d):
    """A source's documents as its pages, every third without text; a seventh of all were read before."""
    docs = tables.table(spark, d, "documents").filter("text is not null")
    pages = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text")).alias("text"), F.encode("text", "UTF-8").alias("image"))
    cache = docs.filter("doc_id % 7 = 0").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.lit(recognise.FAST).alias("resolution"), F.lit("cover").alias("text"))
    return recognise.recognised(pages, cache, _stand_in)[0].select("page", "ocr", "error", F.md5("text").alias("h"))


def fetched_mixed(spark, d):
    """Documents as fetched files of five kinds; some are broken."""
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "pmc", "kdca", "ftp", "html"))), (F.col("doc_id") % 5 + 1).cast("int"))
    pmc = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<article><front/><body><p>"), F.col("doc_id").cast("string"), F.lit("</p></body></article>"))).otherwise("<no")
    kdca = F.concat(F.lit("<r><HEAD><CODE>"), F.when(F.col("doc_id") % 2 == 0, "S001").otherwise("E9"), F.lit("</CODE><MESSAGE>m</MESSAGE></HEAD><svc><CNTNTSSJ>t</CNTNTSSJ></svc></r>"))
    html = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<h1>T</h1><![x[<p>"), F.col("doc_id").cast("string")))
    fetched = tables.table(spark, d, "documents").select(F.col("doc_id").alias("key"), kind.alias("kind"), F.concat(F.lit("http://s/"), F.col("doc_id").cast("string")).alias("url"), F.when(kind == "pmc", pmc).when(kind == "kdca", kdca).when(kind == "html", html).alias("html"))
    return acquire.parse_mixed(fetched)


QUERIES = {f.__name__: f for f in (robots_allowed, request_schedule, text_encodings, staged_recognition, fetched_mixed)}
_ALLOWED = f"""
WITH told AS (SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS site, regexp_replace(url, '^[^:/?#]+://[^/?#]*', '') AS path FROM pages WHERE url IS NOT NULL),
kinds AS (SELECT *, ('0x' || substring(md5(site), 1, 1))::INT % {len(FILES)} AS kind FROM told),
allowed AS (SELECT page_id, site, CASE kind WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN starts_with(path, '/en/1') OR NOT (starts_with(path, '/en') OR starts_with(path, '/fr/8')) ELSE TRUE END AS allowed,
  CASE kind WHEN 3 THEN 3 WHEN 4 THEN 2 END::BIGINT AS delay FROM kinds)"""
ORACLE = {
    "robots_allowed": _ALLOWED + " SELECT page_id, allowed, delay FROM allowed",
    "request_schedule": _ALLOWED
    + """, asked AS (SELECT page_id AS request_id, site, page_id / 4 - CASE WHEN page_id % 5 = 0 THEN 30 ELSE 0 END AS ready, CASE WHEN site LIKE '%.org' THEN 2 ELSE greatest(1, coalesce(delay, 1)) END::DOUBLE AS gap FROM allowed WHERE allowed),
placed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ready, request_id) AS k FROM asked)
SELECT request_id, gap, round(k * gap + max(ready - k * gap) OVER (PARTITION BY site ORDER BY k), 3) AS start FROM placed""",
    "text_encodings": """
WITH made AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN regexp_replace(coalesce(text, ''), '[^\\x00-\\xFF]', '?', 'g') ELSE coalesce(text, '') END AS text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'utf-16-le' WHEN doc_id % 3 = 0 OR NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN 'utf-8' ELSE 'latin-1' END AS encoding, md5(text) AS h FROM made""",
    "staged_recognition": """
WITH pages AS (SELECT source AS doc, doc_id AS page, text AS image, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS text FROM documents WHERE text IS NOT NULL),
bare AS (SELECT *, length(regexp_replace(text, '\\s+', '', 'g')) < 20 AS empty FROM pages),
light AS (SELECT doc FROM bare GROUP BY doc HAVING avg(empty::INT) < 0.9),
wanted AS (SELECT page, image, page % 7 = 0 AS known, page % 7 <> 0 AND starts_with(image, 'E') AS failed FROM bare SEMI JOIN light USING (doc) WHERE empty),
good AS (SELECT page, image FROM wanted WHERE NOT known AND NOT failed AND length(regexp_replace(lower(image), '\\s+', '', 'g')) >= 100)
SELECT bare.page, good.page IS NOT NULL AS ocr, CASE WHEN failed THEN 'ValueError: unreadable' END AS error, md5(coalesce(good.image, bare.text)) AS h
FROM bare LEFT JOIN wanted USING (page) LEFT JOIN good ON bare.page = good.page""",
    "fetched_mixed": """
WITH k AS (SELECT doc_id AS key, doc_id % 2 = 0 AS even, ['pdf', 'pmc', 'kdca', 'ftp', 'html'][doc_id % 5 + 1] AS kind FROM documents)
SELECT key, kind, CASE WHEN kind = 'pdf' THEN 'file' WHEN kind = 'ftp' OR NOT even THEN 'error' ELSE 'text' END AS what, CASE WHEN kind = 'pdf' OR kind = 'html' AND even THEN 'http://s/' || key END AS url,
  CASE WHEN kind = 'html' AND even THEN 'T' WHEN kind = 'kdca' AND even THEN 't' WHEN kind = 'kdca' THEN '' END AS title,
  CASE WHEN even AND kind = 'html' THEN 'T' || chr(10) || key WHEN even AND kind = 'pmc' THEN '# ' || chr(10) || ' ' || chr(10) || chr(10) || key WHEN even AND kind = 'kdca' THEN '# t' || chr(10) || '질병관리청 국가건강정보포털' || chr(10) || chr(10) END AS text,
  CASE WHEN kind = 'ftp' THEN 'unknown kind ftp' WHEN kind = 'pmc' AND NOT even THEN 'no article' WHEN kind = 'kdca' AND NOT even THEN 'E9 m' WHEN kind = 'html' AND NOT even THEN 'nothing was fetched' END AS error FROM k""",
}
