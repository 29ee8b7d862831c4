"""M7: HTML over ``pages``, XML made of ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup
from ..sources import tables


def _pages(spark, d):
    return tables.table(spark, d, "pages")


def html_links(spark, d):
    """Links whose URL has an a, in any case."""
    return markup.links(_pages(spark, d), "a", "[a-z]").select("page_id", "url", "label")


def html_title(spark, d):
    """X2."""
    return _pages(spark, d).select("page_id", markup.title(F.col("html")).alias("title"))


def html_main_text(spark, d):
    """X3."""
    return markup.main_text(_pages(spark, d)).select("page_id", F.length("text").cast("long").alias("n"), "text")


def xml_article_meta(spark, d):
    """X4, X5."""
    xml = F.format_string(
        '<article><front><journal-title>%s</journal-title><article-title>A <i>title</i>\n of %d</article-title><pub-date><year>%d</year></pub-date><license xmlns:x="u" %s><p>terms %d</p></license></front></article>',
        F.col("source"),
        F.col("doc_id"),
        F.lit(2000) + F.col("doc_id") % 25,
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('x:href="http://l/'), F.col("doc_id").cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.col("doc_id"),
    )
    return tables.table(spark, d, "documents").select("doc_id", xml.alias("xml")).select("doc_id", markup.article_meta(F.col("xml")).alias("m")).select("doc_id", "m.*")


def xml_sections_merge(spark, d):
    """A conversation's turns as sections named by whether the turn is the user's."""
    rows = tables.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 0, "a").otherwise("b").alias("name"), F.when(F.col("turn") % 7 == 6, " ").otherwise(F.col("text")).alias("text"))
    return markup.merged_sections(rows).select("doc", F.col("island").cast("long").alias("island"), "name", "parts", F.md5(F.col("text").cast("binary")).alias("h"))


def xml_article_text(spark, d):
    """Articles made of documents: an abstract, nested sections, a list and a table."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]+", " ")
    xml = F.format_string(
        "<r><article><front><journal-meta><journal-title-group><journal-title>%s</journal-title></journal-title-group></journal-meta><article-meta><title-group><article-title>A <i>title</i>\n %d</article-title></title-group><pub-date><year>2001</year></pub-date>%s</article-meta></front>"
        "<body><p>first</p><sec><title>One</title><p>%s</p><sec><title>Two</title><list><list-item><p>a</p></list-item><list-item><p>b <b>c</b></p></list-item></list></sec></sec><fig>no</fig><table-wrap><caption>t</caption><table><tr><th>x</th><td> </td></tr><tr><td/></tr></table></table-wrap></body></article></r>",
        F.col("source"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "<abstract><p>so it is</p></abstract>").otherwise(""), words,
    )
    rows = tables.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 7 != 0, xml).otherwise("<no").alias("xml"))
    return markup.article_texts(rows).select("doc", F.md5("text").alias("h"))


def xml_portal_text(spark, d):
    """Portal entries made of documents; every fifth answer is an error."""
    part = lambda name, said: f"<cntntsCl><CNTNTS_CL_NM>{name}</CNTNTS_CL_NM><CNTNTS_CL_CN>{said}</CNTNTS_CL_CN></cntntsCl>"
    xml = F.concat(
        F.lit("<r><HEAD><CODE>"), F.when(F.col("doc_id") % 5 == 0, "E9").otherwise("S001"), F.lit("</CODE><MESSAGE>m</MESSAGE></HEAD><svc><CNTNTSSJ> t "), F.col("doc_id").cast("string"),
        F.lit("</CNTNTSSJ>" + part("a", "one") + part("a", "&lt;p&gt;two&lt;/p&gt;&lt;p&gt;three&lt;/p&gt;") + part("b", "http://x/y") + part("참고문헌", "r")),
        F.when(F.col("doc_id") % 2 == 0, part("a", "four")).otherwise(part("c", "five\n\n\n\nsix")), F.lit(part("d", " ") + "</svc></r>"),
    )
    return markup.portal_texts(tables.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), xml.alias("xml")))


QUERIES = {f.__name__: f for f in (html_links, html_title, html_main_text, xml_article_meta, xml_sections_merge, xml_article_text, xml_portal_text)}
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
ORACLE = {
    "html_links": f"""
WITH a AS (SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS site, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS labels FROM pages),
l AS (SELECT page_id, site, unnest(hrefs) AS href, unnest(labels) AS label, generate_subscripts(hrefs, 1) AS pos FROM a),
u AS (SELECT page_id, pos, site || trim(href) AS url, {_PLAIN.format(x="label")} AS label FROM l)
SELECT page_id, url, first(label ORDER BY pos) AS label FROM u WHERE regexp_matches(url, '(?i)a') AND regexp_matches(label, '[a-z]') GROUP BY 1, 2""",
    "html_title": f"""
SELECT page_id, substring(coalesce(nullif({_PLAIN.format(x="regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}, ''), {_PLAIN.format(x="regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}), 1, 120) AS title FROM pages""",
    "xml_article_meta": """
SELECT doc_id, 'A title of ' || doc_id AS title, source AS journal, (2000 + doc_id % 25)::VARCHAR AS year, CASE WHEN doc_id % 2 = 0 THEN 'http://l/' || doc_id ELSE 'terms ' || doc_id END AS license FROM documents""",
    "xml_sections_merge": """
WITH r AS (SELECT conv_id AS doc, turn AS pos, CASE WHEN turn % 3 = 0 THEN 'a' ELSE 'b' END AS name, text FROM conversations WHERE turn % 7 <> 6 AND trim(text) <> ''),
n AS (SELECT *, CASE WHEN lag(name) OVER (PARTITION BY doc ORDER BY pos) IS NOT DISTINCT FROM name THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS island FROM n)
SELECT doc, island, min(name) AS name, count(*) AS parts, md5(string_agg(text, chr(10) ORDER BY pos)) AS h FROM i GROUP BY 1, 2""",
    "xml_article_text": """
SELECT doc_id AS doc, CASE WHEN doc_id % 7 <> 0 THEN md5('# A title ' || doc_id || chr(10) || source || ' 2001' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## Abstract' || chr(10) || 'so it is' || chr(10) || chr(10) ELSE '' END
  || 'first' || chr(10) || '## One' || chr(10) || trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')) || chr(10) || '### Two' || chr(10) || '- a' || chr(10) || '- b c' || chr(10) || '[표] t' || chr(10) || 'x | ') END AS h FROM documents""",
    "xml_portal_text": """
SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 't ' || doc_id END AS title, CASE WHEN doc_id % 5 = 0 THEN 'E9 m' END AS error,
  CASE WHEN doc_id % 5 <> 0 THEN '# t ' || doc_id || chr(10) || '질병관리청 국가건강정보포털' || chr(10) || chr(10) || '## a' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || 'three' || chr(10)
    || CASE WHEN doc_id % 2 = 0 THEN 'four' ELSE chr(10) || '## c' || chr(10) || 'five' || chr(10) || chr(10) || 'six' END || chr(10) END AS text FROM documents""",
}
