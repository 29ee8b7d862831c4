"""M3, M4: cleaning and chunking of ``documents``. Where pages are needed, a source is a document and its rows are pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, textclean
from ..sources import tables

SKIP = "acknowledg|funding|license"
#: Every fifth line becomes a section title, so that the driver's prose has sections.
TAGS = {"first": "th(e|is)\\b", "numbers": "[0-9]{3}", "shout": "!!", "none": "zzzzqq"}


def _docs(spark, d):
    return tables.table(spark, d, "documents")


def _pages(spark, d):
    return _docs(spark, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")


def clean_normalise(spark, d):
    """K1, on texts with quote marks and odd spaces put in."""
    odd = F.regexp_replace(F.regexp_replace("text", "e\\. ", ".\n » "), " a", " a\t\x07")
    return _docs(spark, d).select("doc_id", F.sha2(T.normalise(odd).cast("binary"), 256).alias("h"), F.length(T.normalise(odd)).cast("long").alias("n"))


def clean_repeated_edges(spark, d):
    """K2 with a share of 2 percent, as sources have few common lines."""
    return textclean.repeated_edges(_pages(spark, d), 0.02, 2).select("doc", "line", "n")


def clean_page_offset(spark, d):
    """K3, with a number put at the end of some pages."""
    numbered = _pages(spark, d).withColumn("text", F.when(F.col("page") % 3 == 0, F.concat("text", F.lit("\n"), (F.col("page") % 9000 + F.length("doc")).cast("string"))).otherwise(F.col("text")))
    return textclean.page_offset(numbered)


def clean_page_lines(spark, d):
    """K4."""
    pages = _pages(spark, d).withColumn("text", F.when(F.col("page") % 4 == 0, F.concat(F.lit("12\nhttps://a.example/x\n"), F.col("text"), F.lit("\n\n77"))).otherwise(F.col("text")))
    return textclean.clean_pages(pages).select("doc", "page", F.size("lines").cast("long").alias("n"), F.sha2(F.array_join("lines", "\n").cast("binary"), 256).alias("h"))


def _paragraphs(spark, d):
    lines = _docs(spark, d).select("doc_id", "source", textclean.lines_of(F.col("text")).alias("lines"))
    return textclean.with_paragraphs(lines, "lines").select("doc_id", "source", "paragraphs")


def clean_join_lines(spark, d):
    """K5."""
    return _paragraphs(spark, d).select("doc_id", F.posexplode("paragraphs").alias("no", "p")).select("doc_id", F.col("no").cast("long").alias("no"), F.length("p").cast("long").alias("n"), F.sha2(F.col("p").cast("binary"), 256).alias("h"))


def clean_noise_lines(spark, d):
    """K6, with an edge of ten characters or more that occurs in texts."""
    clean = textclean.without_noise(F.col("text"), F.array(F.lit("Licensed under the Apache"), F.lit("the")))
    return _docs(spark, d).select("doc_id", F.length(clean).cast("long").alias("n"))


def section_split(spark, d):
    """K7."""
    titled = F.array_join(F.transform(textclean.lines_of(F.col("text")), lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("## "), x)).when(i % 7 == 3, F.concat(F.lit("# "), x)).otherwise(x)), "\n")
    found = textclean.sections(_docs(spark, d).select("doc_id", titled.alias("text")), SKIP)
    return found.select("doc_id", "section_no", "kept_no", "title", F.length("body").cast("long").alias("n"))


def heading_lines(spark, d):
    """How many lines of a text are headings, bullets or sentence ends, with marks put before some."""
    lines = F.transform(textclean.lines_of(F.col("text")), lambda x, i: F.concat(F.when(i % 4 == 1, "2. ").when(i % 4 == 2, "• ").otherwise(""), x))
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    return _docs(spark, d).select("doc_id", count(textclean.HEADING).alias("headings"), count(textclean.BULLET).alias("bullets"), count("[.!?。」』:;]\\z").alias("ends"))


def _units(spark, d):
    return _paragraphs(spark, d).select("doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("s").alias("section"), F.col("doc_id").cast("string").alias("label"), (F.col("doc_id") % 3 == 0).alias("sectioned"), F.array_join("paragraphs", "\n").alias("text"))


def chunk_fixed(spark, d):
    """K9, K11."""
    return chunking.fixed_chunks(_units(spark, d), False).select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("h"))


def chunk_fixed_ctx(spark, d):
    """With headers and ids."""
    rows = chunking.chunk_ids(chunking.fixed_chunks(_units(spark, d), True), "piece_no")
    return rows.select("chunk_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("h"))


def _section(spark, d):
    marked = F.flatten(F.transform("paragraphs", lambda p, i: F.when(i % 6 == 3, F.array(F.concat(F.lit("3. "), F.substring(p, 1, 30)), p)).otherwise(F.array(p))))
    return chunking.section_chunks(_paragraphs(spark, d).select("doc_id", marked.alias("paragraphs")))


def chunk_section(spark, d):
    """K12, with a heading put before every sixth paragraph."""
    return _section(spark, d).select("doc_id", F.col("group_no").cast("long").alias("group_no"), "section", F.col("piece_no").cast("long").alias("piece_no"), F.md5(F.col("text").cast("binary")).alias("h"))


def chunk_ids(spark, d):
    """K13 over section chunks."""
    rows = chunking.chunk_ids(_section(spark, d), "group_no", "piece_no")
    return rows.select("chunk_id", "doc_id", F.length("text").cast("long").alias("n"))


def chunk_tags(spark, d):
    """K14 over fixed chunks."""
    rows = chunking.fixed_chunks(_units(spark, d), False)
    return rows.select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), F.array_join(T.tags(F.col("text"), TAGS), ",").alias("tags"))


def chunk_stats(spark, d):
    """K15."""
    fixed = chunking.fixed_chunks(_units(spark, d), False).select(F.lit("fixed").alias("strategy"), "text")
    return chunking.length_stats(fixed.unionByName(_section(spark, d).select(F.lit("section").alias("strategy"), "text")))


QUERIES = {f.__name__: f for f in (clean_normalise, clean_repeated_edges, clean_page_offset, clean_page_lines, clean_join_lines, clean_noise_lines, section_split, heading_lines, chunk_fixed, chunk_fixed_ctx, chunk_section, chunk_ids, chunk_tags, chunk_stats)}

_SPACE = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_HEAD = textclean.HEADING.replace("\\\\", "\\").replace("'", "''")
_BULLET = textclean.BULLET.replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _normalise(x: str) -> str:
    return f"regexp_replace(regexp_replace(translate({x}, chr(160) || chr(12288) || chr(9), '   '), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g'), '(?m)^{_SPACE}*[»›]{_SPACE}*', '- ', 'g')"


def _edges(pages: str) -> str:
    return f"""
pages AS ({pages}),
stripped AS (SELECT doc, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ls FROM pages),
ends AS (SELECT doc, page, unnest(list_concat(ls[1:3], list_reverse(ls)[1:3])) AS line FROM stripped),
edges AS (SELECT doc, line, count(DISTINCT page) AS n FROM ends GROUP BY 1, 2),
totals AS (SELECT doc, count(*) AS pages FROM stripped WHERE len(ls) > 0 GROUP BY 1)"""


def _paragraphs_sql(rows: str, keys: str) -> str:
    """CTEs from ``rows`` (keys, ls: lines) to ``paras`` (keys, ps)."""
    return f"""
k_all AS (SELECT {keys}, list_filter(list_transform(ls, lambda raw, i: {{'raw': raw, 's': {_strip('raw')}, 'i': i}}), lambda x: x.s <> '') AS k FROM ({rows})),
k_text AS (SELECT {keys}, array_to_string(list_transform(k, lambda x, j: CASE WHEN j = 1 THEN ''
   WHEN x.i - k[j - 1].i > 1 OR (regexp_matches(k[j - 1].s, '{_HEAD}') AND length(k[j - 1].s) <= 40) OR regexp_matches(x.s, '{_BULLET}') OR regexp_matches(x.s, '{_HEAD}')
     OR regexp_matches(k[j - 1].s, '[.!?。」』:;]$') THEN chr(30)
   WHEN NOT ends_with(k[j - 1].raw, ' ') AND length(k[j - 1].s) >= 20 AND regexp_matches(k[j - 1].s, '[가-힣]$') AND regexp_matches(x.s, '^[가-힣]') THEN '' ELSE ' ' END || x.s), '') AS t FROM k_all),
paras AS (SELECT {keys}, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(t, chr(30)) END AS ps FROM k_text)"""


_PARAS = _paragraphs_sql("SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents", "doc_id, source")


def _windows(size: int, keys: str) -> str:
    """CTEs from ``body`` (keys, t) to ``pieces`` (keys, no, piece)."""
    half = size // 2
    part = f"substring(t, start + {half + 1}, least(start + {size}, n) - start - {half})"
    last = lambda w: f"CASE WHEN instr(reverse({part}), '{w[::-1]}') > 0 THEN least(start + {size}, n) - instr(reverse({part}), '{w[::-1]}') - {len(w)} + 1 ELSE -1 END"
    stop = f"CASE WHEN start + {size} >= n THEN n WHEN {last('. ')} > 0 THEN {last('. ')} + 1 WHEN {last(' ')} > 0 THEN {last(' ')} + 1 ELSE start + {size} END"
    return f""",
sized AS (SELECT {keys}, t, length(t) AS n FROM body),
cuts AS (
  SELECT {keys}, t, n, 0::BIGINT AS start, ({stop})::BIGINT AS stop FROM (SELECT *, 0::BIGINT AS start FROM sized WHERE n > {size})
  UNION ALL
  SELECT {keys}, t, n, start, ({stop})::BIGINT FROM (SELECT {keys}, t, n, greatest(stop - 100, start + 1) AS start FROM cuts WHERE stop < n)),
cut_texts AS (SELECT {keys}, start, {_strip('substring(t, start + 1, stop - start)')} AS piece FROM cuts),
pieces AS (
  SELECT {keys}, 0::BIGINT AS no, t AS piece FROM sized WHERE n <= {size}
  UNION ALL
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY start) - 1, piece FROM cut_texts WHERE piece <> '')"""


_FIXED = f"WITH RECURSIVE {_PARAS.strip()}, body AS (SELECT doc_id, source, array_to_string(ps, chr(10)) AS t FROM paras)" + _windows(500, "doc_id, source")
_SECTION = (
    f"""WITH RECURSIVE {_PARAS.strip()},
headed AS (SELECT doc_id, flatten(list_transform(ps, lambda p, i: CASE WHEN (i - 1) % 6 = 3 THEN ['3. ' || substring(p, 1, 30), p] ELSE [p] END)) AS ps FROM paras),
marked AS (SELECT doc_id, unnest(list_transform(ps, lambda p, i: {{'i': i, 'p': p}})) AS x FROM headed),
flat AS (SELECT doc_id, x.i AS i, x.p AS p, length(x.p) AS n,
  regexp_matches(x.p, '{_HEAD}') AND length(x.p) <= 60 AND coalesce(try_cast(nullif(regexp_extract(x.p, '^(\\d+)\\)', 1), '') AS INT), 0) <= 15 AS h FROM marked),
walk AS (
  SELECT doc_id, i, p, h, n AS size, 0 AS g FROM flat WHERE i = 1
  UNION ALL
  SELECT f.doc_id, f.i, f.p, f.h, CASE WHEN w.size >= 150 AND (f.h OR w.size + f.n > 900) THEN f.n ELSE w.size + f.n END,
    CASE WHEN w.size >= 150 AND (f.h OR w.size + f.n > 900) THEN w.g + 1 ELSE w.g END
  FROM walk w JOIN flat f ON f.doc_id = w.doc_id AND f.i = w.i + 1),
heads AS (SELECT *, last_value(CASE WHEN h THEN substring(regexp_replace(p, '^#+\\s*', ''), 1, 40) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM walk),
groups AS (SELECT doc_id, g, coalesce(last(head ORDER BY i), '') AS section, {_strip("string_agg(p, chr(10) ORDER BY i)")} AS t FROM heads GROUP BY 1, 2),
body AS (SELECT * FROM groups WHERE t <> '')"""
    + _windows(900, "doc_id, g, section")
)
_HEADER = "'[' || source || ' | ' || CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE 's' END WHEN doc_id % 2 <> 0 THEN 's · ' || doc_id || '쪽' ELSE doc_id || '쪽' END || ']' || chr(10)"
_TAGGED = ", ".join(f"CASE WHEN regexp_matches(piece, '(?i){p}') THEN '{n}' END" for n, p in TAGS.items())
ORACLE = {
    "clean_normalise": f"""
SELECT doc_id, sha256(t) AS h, length(t) AS n FROM (SELECT doc_id, {_normalise("regexp_replace(regexp_replace(text, 'e\\. ', '.' || chr(10) || ' » ', 'g'), ' a', chr(160) || 'a' || chr(9) || chr(7), 'g')")} AS t FROM documents)""",
    "clean_repeated_edges": f"WITH {_edges('SELECT source AS doc, doc_id AS page, text FROM documents')} SELECT doc, line, n FROM edges JOIN totals USING (doc) WHERE n >= greatest(2, 0.02 * pages) AND NOT regexp_matches(line, '^[0-9]{{1,4}}$')",
    "clean_page_offset": f"""WITH {_edges("SELECT source AS doc, doc_id AS page, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || (doc_id % 9000 + length(source)) ELSE '' END AS text FROM documents")},
votes AS (SELECT doc, line::BIGINT - page AS diff, count(*) AS n, min(page) AS first FROM ends WHERE regexp_matches(line, '^[0-9]{{1,4}}$') GROUP BY 1, 2),
best AS (SELECT doc, first(diff ORDER BY n DESC, first, diff) AS diff, max(n) AS n FROM votes GROUP BY 1)
SELECT p.doc, CASE WHEN n >= 2 THEN diff ELSE 0 END AS page_offset FROM (SELECT DISTINCT doc FROM pages) p LEFT JOIN best USING (doc)""",
    "clean_page_lines": f"""WITH {_edges("SELECT source AS doc, doc_id AS page, CASE WHEN doc_id % 4 = 0 THEN '12' || chr(10) || 'https://a.example/x' || chr(10) || text || chr(10) || chr(10) || '77' ELSE text END AS text FROM documents")},
kept AS (SELECT doc, list(line) AS e FROM edges JOIN totals USING (doc) WHERE n >= greatest(3, 0.25 * pages) AND NOT regexp_matches(line, '^[0-9]{{1,4}}$') GROUP BY 1),
ls AS (SELECT doc, page, coalesce(e, []) AS e, string_split({_normalise('text')}, chr(10)) AS l FROM pages LEFT JOIN kept USING (doc)),
out AS (SELECT doc, page, list_filter(l, lambda x, i: NOT (list_contains(e, {_strip('x')}) OR (regexp_matches({_strip('x')}, '^[0-9]{{1,4}}$') AND (i <= 3 OR i > len(l) - 3)) OR regexp_matches({_strip('x')}, '^(https?://|www\\.)\\S+$'))) AS l FROM ls)
SELECT doc, page, len(l) AS n, sha256(array_to_string(l, chr(10))) AS h FROM out""",
    "clean_join_lines": f"WITH {_PARAS.strip()} SELECT doc_id, no, length(p) AS n, sha256(p) AS h FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS no FROM paras)",
    "clean_noise_lines": """
SELECT doc_id, length(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[^가-힣A-Za-z0-9]+', '', 'g')) >= 3 AND NOT contains(x, 'Licensed under the Apache')), chr(10))) AS n FROM documents""",
    "section_split": f"""
WITH ls AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'i': i, 'x': CASE WHEN (i - 1) % 5 = 2 THEN '## ' || x WHEN (i - 1) % 7 = 3 THEN '# ' || x ELSE x END}})) AS l FROM documents),
t AS (SELECT doc_id, l.i AS i, l.x AS x, regexp_extract(l.x, '^## (.+)', 1) AS title FROM ls),
g AS (SELECT *, sum((title <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM t),
b AS (SELECT doc_id, no::BIGINT AS section_no, {_strip('max(title)')} AS title, string_agg(CASE WHEN title = '' AND NOT starts_with(x, '# ') THEN x END, chr(10) ORDER BY i) AS body FROM g GROUP BY 1, 2)
SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS kept_no, title, length(body) AS n FROM b WHERE section_no > 0 AND body IS NOT NULL AND NOT regexp_matches(lower(title), '{SKIP}')""",
    "heading_lines": f"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 1 THEN '2. ' WHEN (i - 1) % 4 = 2 THEN '• ' ELSE '' END || x) AS l FROM documents)
SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '{_HEAD}'))) AS headings, len(list_filter(l, lambda x: regexp_matches(x, '{_BULLET}'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '[.!?。」』:;]$'))) AS ends FROM l""",
    "chunk_fixed": _FIXED + " SELECT doc_id, no AS piece_no, length(piece) AS n, md5(piece) AS h FROM pieces",
    "chunk_fixed_ctx": _FIXED + f", c AS (SELECT doc_id, no, {_HEADER} || piece AS t FROM pieces) SELECT printf('%s#%04d', doc_id::VARCHAR, row_number() OVER (PARTITION BY doc_id ORDER BY no)) AS chunk_id, length(t) AS n, md5(t) AS h FROM c",
    "chunk_section": _SECTION + " SELECT doc_id, g AS group_no, section, no AS piece_no, md5(piece) AS h FROM pieces",
    "chunk_ids": _SECTION + " SELECT printf('%s#%04d', doc_id::VARCHAR, row_number() OVER (PARTITION BY doc_id ORDER BY g, no)) AS chunk_id, doc_id, length(piece) AS n FROM pieces",
    "chunk_tags": _FIXED + f" SELECT doc_id, no AS piece_no, concat_ws(',', {_TAGGED}) AS tags FROM pieces",
    "chunk_stats": _FIXED
    + """ SELECT 'fixed' AS strategy, count(*) AS chunks, round_even(avg(length(piece)), 1) AS mean, median(length(piece)) AS median, min(length(piece)) AS least, max(length(piece)) AS most, sum(length(piece))::BIGINT AS total FROM pieces
UNION ALL SELECT * FROM ("""
    + _SECTION
    + " SELECT 'section', count(*), round_even(avg(length(piece)), 1), median(length(piece)), min(length(piece)), max(length(piece)), sum(length(piece))::BIGINT FROM pieces)",
}
