"""Retrieval evaluation: gold positions (Q1), labels (Q2), hits (Q3), reachability (Q4), metrics (Q5), summaries (Q6), citations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def _range(text: Column) -> Column:
    """'a-b' or 'a' as numbers; anything else: none."""
    low, high = F.regexp_extract(text, "^(\\d+)(?:-(\\d+))?\\z", 1), F.regexp_extract(text, "^(\\d+)(?:-(\\d+))?\\z", 2)
    a = low.try_cast("int")
    b = F.when(high == "", a).otherwise(high.try_cast("int"))
    return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))


def gold(questions: DataFrame) -> DataFrame:
    """Q1: rows (query_id, doc, pages) of specs like ``a:1-3,5; b``; no page means any; a document's pages are merged."""
    parts = F.filter(F.transform(F.split("spec", "[;\n]"), strip), lambda x: x != "")
    entry = questions.select("query_id", F.explode(parts).alias("part"))
    doc = strip(F.substring_index("part", ":", 1))
    pages = F.when(F.contains("part", F.lit(":")), F.flatten(F.transform(F.split(F.regexp_extract("part", ":(.*)$", 1), ","), lambda p: _range(strip(p))))).otherwise(F.array().cast("array<int>"))
    each = entry.select("query_id", doc.alias("doc"), F.explode_outer(pages).alias("page"))
    return each.groupBy("query_id", "doc").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def label_pages(label: Column) -> Column:
    """Q2: the pages of a label, none for a name."""
    return _range(strip(label))


def marked_hits(found: DataFrame, gold_rows: DataFrame) -> DataFrame:
    """Q3: ``found`` (query_id, doc, pages, ...) with doc_hit and page_hit: the document is gold, and a page is, or any may be."""
    g = gold_rows.select("query_id", "doc", F.col("pages").alias("gold_pages"))
    joined = found.join(g, ["query_id", "doc"], "left")
    doc_hit = F.col("gold_pages").isNotNull()
    page_hit = doc_hit & ((F.size("gold_pages") == 0) | F.arrays_overlap("pages", "gold_pages"))
    return joined.withColumn("doc_hit", doc_hit).withColumn("page_hit", F.coalesce(page_hit, F.lit(False))).drop("gold_pages")


def reachable(chunks: DataFrame, gold_rows: DataFrame) -> DataFrame:
    """Q4: rows (query_id, reachable): whether any chunk (doc, pages) of the index is a hit."""
    spread = gold_rows.join(chunks.select("doc", F.col("pages").alias("own")), "doc", "left")
    hit = F.col("own").isNotNull() & ((F.size("pages") == 0) | F.arrays_overlap("own", "pages"))
    return spread.groupBy("query_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("reachable"))


def query_metrics(marked: DataFrame) -> DataFrame:
    """Q5: hits, the first hit's rank, academic chunks and the printed list for each strategy and query."""
    line = F.concat("doc", F.lit(":"), "label", F.lit("("), F.format_number("score", 2), F.lit(")"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), " / ")
    return marked.groupBy("strategy", "query_id").agg(
        F.bool_or("doc_hit").alias("doc_hit"),
        F.bool_or("page_hit").alias("page_hit"),
        F.min(F.when(F.col("page_hit"), F.col("rank"))).alias("first_rank"),
        F.count_if(F.col("doc_type") == "academic").alias("n_academic"),
        ordered.alias("top"),
    )


def strategy_summary(metrics: DataFrame, reach: DataFrame) -> DataFrame:
    """Q6: counts, hit rates and the rate among reachable questions for each strategy."""
    joined = metrics.join(reach, "query_id", "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))
    n = lambda c: F.count_if(F.col(c))
    return joined.groupBy("strategy").agg(
        F.count("*").alias("questions"),
        n("reachable").alias("reachable"),
        n("doc_hit").alias("doc_hits"),
        n("page_hit").alias("page_hits"),
        F.bround(F.avg("n_academic"), 1).alias("mean_academic"),
        F.round(F.try_divide(n("page_hit"), F.count("*")), 6).alias("rate"),
        F.round(F.try_divide(F.count_if(F.col("page_hit") & F.col("reachable")), n("reachable")), 6).alias("rate_reachable"),
    )


def setting_suffix(per_doc: int = 0, academic: int = 0, public: int = 0, translated: bool = False, expanded: bool = False, public_per_doc: int = 0, raw: bool = False) -> str:
    """Q8: +doc2+ac1+pub5+enx+ppd1+raw; what is 0 or off is left out."""
    parts = [(f"+doc{per_doc}", per_doc), (f"+ac{academic}", academic), (f"+pub{public}", public), ("+en" + "x" * expanded, translated), (f"+ppd{public_per_doc}", public_per_doc), ("+raw", raw)]
    return "".join(text for text, on in parts if on)


def strategy_grid(index: DataFrame, questions: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame], only: list[str] | None = None, suffix: str = "") -> DataFrame:
    """Q8: the search's rows for each strategy of an index (strategy, ...) and each question, with strategy and its suffix.

    ``search``: (chunks of one strategy, questions) to rows. An index has few strategies; their names are collected.
    """
    names = sorted(r[0] for r in index.select("strategy").distinct().collect())
    found = [search(index.filter(F.col("strategy") == n).drop("strategy"), questions).withColumn("strategy", F.lit(n + suffix)) for n in names if not only or n in only]
    if not found:
        raise ValueError(f"none of the strategies {names} is asked for")
    return reduce(DataFrame.unionByName, found)


def citation(doc_type: Column, title: Column, doc: Column, label: Column, ocr: Column) -> Column:
    """[type] title (doc) place, with a page mark for numeric labels and a mark for recognised text."""
    page = F.when(F.regexp_replace(label, "-", "").rlike("^[0-9]+\\z"), F.concat(label, F.lit("쪽"))).otherwise(label)
    return F.concat(F.lit("["), doc_type, F.lit("] "), title, F.lit(" ("), doc, F.lit(") "), page, F.when(ocr, F.lit(" [OCR]")).otherwise(F.lit("")))


def setting_label(strategy: Column, k: Column, per_doc: Column, public: Column, public_per_doc: Column, translated: Column) -> Column:
    """fixed@10/doc2/pub5/ppd1/en; parts that are null or 0 are left out."""
    part = lambda name, c: F.when(c > 0, F.concat(F.lit(name), c.cast("string")))
    return F.concat_ws("/", F.concat(strategy, F.lit("@"), k.cast("string")), part("doc", per_doc), part("pub", public), part("ppd", public_per_doc), F.when(translated, F.lit("en")))


def setting_parts(label: Column) -> Column:
    """The struct that ``setting_label`` was made of."""
    number = lambda name: F.regexp_extract(label, f"/{name}(\\d+)", 1).try_cast("int")
    return F.struct(
        F.substring_index(label, "@", 1).alias("strategy"),
        F.regexp_extract(label, "@(\\d+)", 1).try_cast("int").alias("k"),
        number("doc").alias("per_doc"),
        number("pub").alias("public"),
        number("ppd").alias("public_per_doc"),
        label.rlike("/en\\z").alias("translated"),
    )
