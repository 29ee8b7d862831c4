"""Cleaning of page text: edges (K2), printed page numbers (K3), page lines (K4), paragraphs (K5), noise (K6), sections (K7).

What concerns one text is an expression over its lines; only K2 and K3 look at all pages of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, bound, normalise, settled, stretches, strip

#: Fixed shapes of headings, bullets and sentence ends of Korean public documents and journals.
HEADING = "^(#{1,6} |[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\\.\\s|\\d{1,2}\\.\\s|[가-하]\\.\\s|\\d{1,2}\\)\\s|[①-⑳]\\s?|제\\s?\\d+\\s?[장절]\\s)"
BULLET = "^([•·▪■□○●◦※\\-–»]|\\d{1,2}[.)]\\s|[가-하][.)]\\s|[①-⑳])"
SENTENCE_END = ".!?。」』:;"
#: Shorter lines are cells or titles, not wrapped ones; longer headings are text.
WRAP_LEAST, HEADING_MOST = 20, 40
EDGE_LINES, EDGE_SHARE, EDGE_LEAST = 3, 0.25, 3
#: Between paragraphs while they are put together; never in normalised text.
MARK = "\x1e"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def edge_lines(pages: DataFrame) -> DataFrame:
    """K2, K3: rows (doc, page, line, times): stripped non-blank lines among the first or last three, and how often there."""
    stripped = pages.select("doc", "page", F.filter(F.transform(lines_of(F.col("text")), strip), lambda x: x != "").alias("lines"))
    ends = F.concat(F.slice("lines", 1, EDGE_LINES), F.slice(F.reverse("lines"), 1, EDGE_LINES))
    return stripped.select("doc", "page", F.explode(ends).alias("line")).groupBy("doc", "page", "line").agg(F.count("*").alias("times"))


def repeated_edges(pages: DataFrame, share: float = EDGE_SHARE, least: int = EDGE_LEAST) -> DataFrame:
    """K2: rows (doc, line, n): lines at the edges of at least max(``least``, ``share`` of the pages with text), bare numbers apart."""
    edges = edge_lines(pages)
    counts = edges.groupBy("doc", "line").agg(F.count("*").alias("n"))
    total = pages.filter(strip(F.col("text")) != "").groupBy("doc").agg(F.count("*").alias("pages"))
    kept = counts.join(total, "doc").filter(F.col("n") >= F.greatest(F.lit(float(least)), F.col("pages") * share))
    return kept.filter(~F.col("line").rlike("^[0-9]{1,4}\\z")).select("doc", "line", "n")


def page_offset(pages: DataFrame) -> DataFrame:
    """K3: rows (doc, page_offset): the most frequent difference of a number at an edge and the page, with two votes at least, else 0.

    A line of a short page that is among the first and the last three votes twice. Ties go to the difference seen
    first: on the least page, then by the lesser difference.
    """
    votes = edge_lines(pages).filter(F.col("line").rlike("^[0-9]{1,4}\\z")).withColumn("diff", F.col("line").cast("long") - F.col("page"))
    counted = votes.groupBy("doc", "diff").agg(F.sum("times").alias("n"), F.min("page").alias("first"))
    best = counted.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("o"), "first", "diff")).alias("b"))
    docs = pages.select("doc").distinct()
    return docs.join(best, "doc", "left").select("doc", F.when(-F.col("b.o") >= 2, F.col("b.diff")).otherwise(F.lit(0).cast("long")).alias("page_offset"))


def kept_lines(text: Column, edges: Column) -> Column:
    """K4: lines of a normalised text without edges, bare numbers in the first or last three lines, and bare URLs.

    Patterns allow for white space at a line's ends, so that only texts with edges have their lines stripped.
    """

    def kept(x: Column) -> Column:
        lines, n = x["lines"], F.size(x["lines"])

        def keep(line: Column, i: Column) -> Column:
            edge = (F.size(edges) > 0) & F.array_contains(edges, strip(line))
            number = line.rlike(f"^[{SPACE}]*+[0-9]{{1,4}}[{SPACE}]*+\\z") & ((i < EDGE_LINES) | (i >= n - EDGE_LINES))
            return ~(edge | number | line.rlike(f"^[{SPACE}]*+(https?://|www\\.)\\S*[^{SPACE}][{SPACE}]*+\\z"))

        return F.filter(lines, keep)

    return bound(F.struct(lines_of(text).alias("lines")), kept)


def clean_pages(pages: DataFrame) -> DataFrame:
    """K1, K4: rows (doc, page, lines)."""
    edges = repeated_edges(pages).groupBy("doc").agg(F.collect_set("line").alias("edges"))
    joined = pages.join(edges, "doc", "left").select("doc", "page", normalise(F.col("text")).alias("clean"), F.coalesce("edges", F.array().cast("array<string>")).alias("edges"))
    return joined.select("doc", "page", kept_lines(F.col("clean"), F.col("edges")).alias("lines"))


def with_paragraphs(df: DataFrame, lines: str, out: str = "paragraphs") -> DataFrame:
    """K5: ``df`` with wrapped ``lines`` (an array) put together as paragraphs.

    A paragraph starts after a blank line, a short heading or a sentence end, and at a bullet or heading. Within one,
    lines are joined by a space, or by nothing where a long line ends and the next begins within a Hangul word.
    Each line looks at the non-blank one before it only, so this is a projection, not a fold.
    """
    each = F.transform(lines, lambda raw, i: F.struct(raw.alias("raw"), strip(raw).alias("s"), i.alias("i")))
    seen = df.withColumn("k_full", settled(F.filter(each, lambda x: x["s"] != "")))
    # each line beside the one before it, null for the first
    seen = seen.withColumn("k_pairs", F.zip_with("k_full", F.slice(F.concat(F.array(F.lit(None)), "k_full"), F.lit(1), F.size("k_full")), lambda x, b: F.struct(x.alias("x"), b.alias("b"))))

    def piece(pair: Column) -> Column:
        before, x = pair["b"], pair["x"]
        prev, cur = before["s"], x["s"]
        last = F.substring(prev, -1, 1)
        starts = (x["i"] - before["i"] > 1) | (prev.rlike(HEADING) & (F.length(prev) <= HEADING_MOST)) | cur.rlike(BULLET) | cur.rlike(HEADING) | F.contains(F.lit(SENTENCE_END), last)
        split_word = ~before["raw"].endswith(" ") & (F.length(prev) >= WRAP_LEAST) & last.between("가", "힣") & cur.rlike("^[가-힣]")
        return F.concat(F.when(before.isNull(), "").when(starts, MARK).when(split_word, "").otherwise(" "), cur)

    joined = seen.withColumn("k_text", settled(F.array_join(F.transform("k_pairs", piece), "")))
    return joined.withColumn(out, settled(F.when(F.col("k_text") == "", F.array().cast("array<string>")).otherwise(F.split("k_text", MARK)))).drop("k_full", "k_pairs", "k_text")


def without_noise(text: Column, edges: Column, least_edge: int = 10, least_letters: int = 3) -> Column:
    """K6: a recognised page without lines that contain a long edge or have at most two letters or digits."""

    def keep(line: Column) -> Column:
        letters = line.rlike(f"^[^가-힣A-Za-z0-9]*+([가-힣A-Za-z0-9][^가-힣A-Za-z0-9]*+){{{least_letters}}}")
        return letters & ~F.exists(edges, lambda e: (F.length(e) >= least_edge) & F.contains(line, e))

    return F.array_join(F.filter(lines_of(text), keep), "\n")


def sections(docs: DataFrame, skip: str) -> DataFrame:
    """K7: rows (doc_id, section_no, kept_no, title, body) of texts with '## ' titles; '# ' lines go, deeper titles are text.

    Sections without lines, those whose title matches ``skip``, and what stands before the first title go. section_no
    counts all titles, kept_no the sections that are kept. A text without any title has no section.
    """
    lines = docs.select("doc_id", settled(lines_of(F.col("text"))).alias("lines"))
    place = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike("^## ."), i)), lambda i: i.isNotNull())
    marked = lines.withColumn("titles", settled(place))

    def section(k: Column, at: Column, end: Column) -> Column:
        body = F.filter(F.slice("lines", at + 2, end - at - 1), lambda x: ~x.startswith("# "))
        title = strip(F.regexp_extract(F.get("lines", at), "^## (.+)", 1))
        return F.struct((k + 1).cast("long").alias("section_no"), title.alias("title"), F.size(body).alias("n"), F.array_join(body, "\n").alias("body"))

    kept = F.filter(stretches(F.col("lines"), F.col("titles"), section), lambda x: (x["n"] > 0) & ~F.lower(x["title"]).rlike(skip))
    each = marked.select("doc_id", settled(kept).alias("kept")).select("doc_id", F.posexplode("kept").alias("k", "x"))
    return each.select("doc_id", "x.section_no", (F.col("k") + 1).cast("long").alias("kept_no"), "x.title", "x.body")


def heading(text: Column) -> Column:
    """K16."""
    return text.rlike(HEADING)


__all__ = ["SPACE", "clean_pages", "edge_lines", "heading", "kept_lines", "page_offset", "repeated_edges", "sections", "with_paragraphs", "without_noise"]
