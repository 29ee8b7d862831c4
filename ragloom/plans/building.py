"""M3, M4 joined: page texts made of ``documents`` to units and chunks.

Documents of the formats pmc and kdca have their whole text, with titles put in, as page 0; the others have six lines
a page, the page's number at the end of some, and recognised text on every third page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import settled
from ..operators import building, models, textclean
from ..sources import tables
from ..sources.sinks import checkpointed
from .catalog import FORMAT
from .chunking import _SPACE, SKIP, TAGS, _edges, _normalise, _paragraphs_sql, _strip, _windows
from .chunking import _HEAD as _HEADING

LINES = 6
DISEASES = {"one": "src1", "two": "src[27]", "none": "zz"}


def _docs(spark, d):
    return tables.table(spark, d, "documents").selectExpr("doc_id", f"{FORMAT} AS format", "concat('T ', source) AS title", "lang", "'public' AS doc_type", "text")


def _pages(docs):
    lines = docs.withColumn("lines", settled(textclean.lines_of(F.col("text"))))
    titled = F.array_join(F.transform("lines", lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("## "), x)).when(i % 7 == 3, F.concat(F.lit("# "), x)).otherwise(x)), "\n")
    whole = lines.filter(F.col("format").isin(*building.SECTIONED)).select("doc_id", F.lit(0).alias("page"), titled.alias("text"), F.lit(False).alias("ocr"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES).cast("int")), lambda k: F.array_join(F.slice("lines", k * LINES + 1, LINES), "\n"))
    paged = lines.filter(~F.col("format").isin(*building.SECTIONED)).select("doc_id", settled(cut).alias("cut")).select("doc_id", F.posexplode("cut").alias("k", "text"))
    numbered = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n"), (F.col("k") + 8).cast("string"))).otherwise(F.col("text"))
    return whole.unionByName(paged.select("doc_id", (F.col("k") + 1).alias("page"), numbered.alias("text"), (F.col("k") % 3 == 1).alias("ocr")))


def _units(spark, d):
    docs = _docs(spark, d)
    return docs, building.parse_units(docs, _pages(docs), SKIP)


def parse_units(spark, d):
    """K8, K1 to K7."""
    _, units = _units(spark, d)
    return units.select("doc_id", "sectioned", "page", "label", "section", "ocr", F.size("paras").cast("long").alias("n"), F.md5(F.array_join("paras", "\n").cast("binary")).alias("h"))


def chunk_build(spark, d):
    """K12 over pages, K13: the chunks of two strategies with places, flags and tags."""
    docs, units = _units(spark, d)
    units = checkpointed(units)  # both strategies read them
    both = building.build_chunks(docs, units, "section_ctx", DISEASES, TAGS).unionByName(building.build_chunks(docs, units, "fixed_ctx", DISEASES, TAGS))
    joined = [F.array_join(c, ",").alias(c) for c in ("pages", "diseases", "groups")]
    return both.select("strategy", "chunk_id", F.col("page").cast("long").alias("page"), F.col("page_end").cast("long").alias("page_end"), "label", "section", "ocr", *joined, F.md5(F.col("text").cast("binary")).alias("h"))


def index_build(spark, d):
    """V5: user turns as chunks, those of conversations divisible by 3 in the cache already; vectors by the stand-in model, of length 1."""
    turns = tables.table(spark, d, "conversations").filter("role = 'user' and text is not null").select("conv_id", "turn", "text")
    cache = models.embed(turns.filter("conv_id % 3 = 0").select(models.cache_key("m1", F.col("text")).alias("key"), "text").dropDuplicates(["key"]))
    index, _ = building.build_index(turns, cache, "m1")
    return index.select("conv_id", "turn", F.size("vector").cast("long").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


QUERIES = {f.__name__: f for f in (parse_units, chunk_build, index_build)}

_UNITS = f"""
docs AS (SELECT doc_id, 'T ' || source AS title, ({FORMAT}) IN ('pmc', 'kdca') AS sectioned, string_split(text, chr(10)) AS l FROM documents),
paged AS (SELECT doc_id, page, array_to_string(l[(page - 1) * {LINES} + 1 : page * {LINES}], chr(10)) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || (page + 7) ELSE '' END AS text, page % 3 = 2 AS ocr
  FROM (SELECT *, unnest(range(1, (len(l) - 1) // {LINES} + 2)) AS page FROM docs WHERE NOT sectioned)),
{_edges("SELECT doc_id AS doc, page, text FROM paged").strip()},
repeated AS (SELECT doc, list(line) AS e FROM edges JOIN totals USING (doc) WHERE n >= greatest(3, 0.25 * pages) AND NOT regexp_matches(line, '^[0-9]{{1,4}}$') GROUP BY 1),
votes AS (SELECT doc, line::BIGINT - page AS diff, count(*) AS n, min(page) AS first FROM ends WHERE regexp_matches(line, '^[0-9]{{1,4}}$') GROUP BY 1, 2),
best AS (SELECT doc, first(diff ORDER BY n DESC, first, diff) AS diff, max(n) AS n FROM votes GROUP BY 1),
read AS (SELECT doc_id, page, ocr, coalesce(e, []) AS e, text FROM paged LEFT JOIN repeated ON doc = doc_id),
normal AS (SELECT doc_id, page, ocr, e, string_split({_normalise("CASE WHEN ocr THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[^가-힣A-Za-z0-9]+', '', 'g')) >= 3 AND len(list_filter(e, lambda y: length(y) >= 10 AND contains(x, y))) = 0), chr(10)) ELSE text END")}, chr(10)) AS l FROM read),
{_paragraphs_sql(f"SELECT doc_id, page, ocr, list_filter(l, lambda x, i: NOT (list_contains(e, {_strip('x')}) OR (regexp_matches({_strip('x')}, '^[0-9]{{1,4}}$') AND (i <= 3 OR i > len(l) - 3)) OR regexp_matches({_strip('x')}, '^(https?://|www\\.)\\S+$'))) AS ls FROM normal", "doc_id, page, ocr").strip()},
titled AS (SELECT doc_id, x.i AS i, x.x AS x FROM (SELECT doc_id, unnest(list_transform(l, lambda x, i: {{'i': i, 'x': CASE WHEN (i - 1) % 5 = 2 THEN '## ' || x WHEN (i - 1) % 7 = 3 THEN '# ' || x ELSE x END}})) AS x FROM docs WHERE sectioned)),
opened AS (SELECT doc_id, i, x, regexp_extract(x, '^## (.+)', 1) AS title, sum((regexp_extract(x, '^## (.+)', 1) <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM titled),
bodies AS (SELECT doc_id, no, {_strip('max(title)')} AS title, list(x ORDER BY i) FILTER (title = '' AND NOT starts_with(x, '# ')) AS l FROM opened WHERE no > 0 GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS page FROM bodies WHERE l IS NOT NULL AND NOT regexp_matches(lower(title), '{SKIP}')),
units AS (
  SELECT doc_id, TRUE AS sectioned, page, title AS label, title AS section, FALSE AS ocr, list_filter(list_transform(l, lambda x: {_strip(f"regexp_replace(x, '{_SPACE}+', ' ', 'g')")}), lambda x: x <> '') AS ps FROM numbered
  UNION ALL
  SELECT p.doc_id, FALSE, page, (page + CASE WHEN n >= 2 THEN diff ELSE 0 END)::VARCHAR, '', ocr, ps FROM paras p LEFT JOIN best ON doc = p.doc_id),
full_units AS (SELECT * FROM units WHERE len(ps) > 0)"""
_HEADER = "'[' || title || ' | ' || CASE WHEN sectioned THEN section WHEN section <> '' THEN section || ' · ' || label || '쪽' ELSE label || '쪽' END || ']' || chr(10)"
_GROUPED = f""",
items AS (SELECT doc_id, sectioned, page, label, section, p, k = 1 AND sectioned AS fresh, length(p) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) AS i,
  NOT sectioned AND regexp_matches(p, '{_HEADING}') AND length(p) <= 60 AND coalesce(try_cast(nullif(regexp_extract(p, '^(\\d+)\\)', 1), '') AS INT), 0) <= 15 AS h
  FROM (SELECT * EXCLUDE (ps), unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM full_units)),
walk AS (
  SELECT doc_id, i, n AS size, 0 AS g FROM items WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.i, CASE WHEN x.fresh OR (w.size >= 150 AND (x.h OR w.size + x.n > 900)) THEN x.n ELSE w.size + x.n END,
    CASE WHEN x.fresh OR (w.size >= 150 AND (x.h OR w.size + x.n > 900)) THEN w.g + 1 ELSE w.g END
  FROM walk w JOIN items x ON x.doc_id = w.doc_id AND x.i = w.i + 1),
headed AS (SELECT items.*, g, last_value(CASE WHEN h THEN substring(regexp_replace(p, '^#+\\s*', ''), 1, 40) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM items JOIN walk USING (doc_id, i)),
grouped AS (SELECT doc_id, g, bool_or(sectioned) AS sectioned, first(page ORDER BY i) AS page, last(page ORDER BY i) AS page_end, first(label ORDER BY i) AS a, last(label ORDER BY i) AS b, list(label ORDER BY i) AS labels,
  CASE WHEN bool_or(sectioned) THEN first(section ORDER BY i) ELSE coalesce(last(head ORDER BY i), '') END AS section, {_strip("string_agg(p, chr(10) ORDER BY i)")} AS t FROM headed GROUP BY 1, 2),
body AS (SELECT doc_id, g, t FROM grouped WHERE t <> '')""" + _windows(900, "doc_id, g")
_PLACED = f""",
placed AS (
  SELECT s.doc_id, s.g, no, piece, page, page_end, sectioned, CASE WHEN a = b OR sectioned THEN a ELSE a || '-' || b END AS label, array_to_string(list_filter(labels, lambda x, i: NOT list_contains(labels[1:i - 1], x)), ',') AS pages, section,
    EXISTS (SELECT 1 FROM full_units u WHERE u.doc_id = s.doc_id AND u.ocr AND u.page BETWEEN s.page AND s.page_end) AS ocr
  FROM grouped s JOIN pieces USING (doc_id, g)),
made AS (SELECT p.*, title, {_HEADER} || piece AS text FROM placed p JOIN (SELECT doc_id, title FROM docs) USING (doc_id))"""


def _chunks(strategy: str) -> str:
    tag = lambda table, c: ", ".join(f"CASE WHEN regexp_matches({c}, '(?i){p}') THEN '{n}' END" for n, p in table.items())
    return f"SELECT '{strategy}' AS strategy, printf('%s#%04d', doc_id::VARCHAR, row_number() OVER (PARTITION BY doc_id ORDER BY g, no)) AS chunk_id, page, page_end, label, section, ocr, pages, concat_ws(',', {tag(DISEASES, 'title')}) AS diseases, concat_ws(',', {tag(TAGS, 'text')}) AS groups, md5(text) AS h FROM made"


_FIXED = ", body AS (SELECT doc_id, page AS g, array_to_string(ps, chr(10)) AS t FROM full_units)" + _windows(500, "doc_id, g") + f""",
made AS (SELECT u.doc_id, page AS g, no, page, page AS page_end, label, label AS pages, section, sectioned, ocr, title, {_HEADER.replace('sectioned', 'u.sectioned')} || piece AS text FROM pieces JOIN full_units u ON u.doc_id = pieces.doc_id AND u.page = pieces.g JOIN (SELECT doc_id, title FROM docs) d ON d.doc_id = u.doc_id)"""
ORACLE = {
    "parse_units": f"WITH {_UNITS.strip()} SELECT doc_id, sectioned, page, label, section, ocr, len(ps) AS n, md5(array_to_string(ps, chr(10))) AS h FROM full_units",
    "chunk_build": f"SELECT * FROM (WITH RECURSIVE {_UNITS.strip()}{_GROUPED}{_PLACED} {_chunks('section_ctx')}) UNION ALL SELECT * FROM (WITH RECURSIVE {_UNITS.strip()}{_FIXED} {_chunks('fixed_ctx')})",
    "index_build": "SELECT conv_id, turn, 8::BIGINT AS n, 1.0::DOUBLE AS norm FROM conversations WHERE role = 'user' AND text IS NOT NULL",
}
