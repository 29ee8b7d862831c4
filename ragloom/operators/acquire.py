"""What is decided around fetching, without the network: kinds (S2), policies (S6, S7), names (S10), ids (S12, S13), listings (S14), boards (S15), attachments (S16), page texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import percent_decoded
from .markup import article_texts, links, main_text, plain_text, portal_texts, title

EMPTY_CHARS, SCAN_SHARE, LEAST_OCR, MOST_FILES = 20, 0.9, 100, 3


def robots_policy(status: Column) -> Column:
    """404 allows all, 401 and 403 and a failed request (null) deny all, else the rules of the file decide."""
    return F.when(status.isNull() | status.isin(401, 403), "deny").when(status == 404, "allow").otherwise("rules")


def request_gap(delay: Column, crawl_delay: Column, least_gap: Column) -> Column:
    """Seconds between two requests to a site: the stated gap, else the greater of both delays."""
    return F.coalesce(least_gap, F.greatest(delay, crawl_delay))


def download_name(disposition: Column, url: Column) -> Column:
    """The name that a download states in UTF-8, else plainly, in quotes or without, else the end of its path, else ``download``.

    Percent signs are read in each of them.
    """
    some = lambda c: F.when(c != "", c)
    extended = percent_decoded(F.regexp_extract(disposition, "(?i)filename\\*\\s*=\\s*UTF-8''([^;]+)", 1))
    quoted = F.regexp_extract(disposition, '(?i)(?:^|[;\\s])filename\\s*=\\s*"([^"]+)"', 1)
    bare = F.trim(F.regexp_extract(disposition, '(?i)(?:^|[;\\s])filename\\s*=\\s*([^";]+)', 1))
    plain = percent_decoded(_decoded(F.coalesce(some(quoted), bare)))
    path = percent_decoded(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "^[^:]+://[^/]*/(?:.*/)?([^/]*)$", 1))
    return F.coalesce(some(extended), some(plain), some(path), F.lit("download"))


@F.pandas_udf(StringType())
def _decoded(names: pd.Series) -> pd.Series:
    """A header's name, read as Latin-1, in the encoding that it is of: UTF-8 if its bytes are valid, else EUC-KR, else as it is."""

    def again(name: str | None) -> str | None:
        for encoding in ("utf-8", "euc-kr"):
            try:
                return name and name.encode("latin-1").decode(encoding)
            except UnicodeError:
                continue
        return name

    return names.map(again)


def masked(text: Column, key: str) -> Column:
    """A log line or URL without the secret key."""
    return F.replace(text, F.lit(key), F.lit("***")) if key else text


def content_urls(rows: DataFrame, endpoint: str) -> DataFrame:
    """Rows (source_id, number, url) of sources (source_id, query): one for each content number; the URL holds no key."""
    each = rows.select("source_id", F.explode(content_numbers(F.col("query"))).alias("number"))
    return each.select("source_id", "number", F.concat(F.lit(endpoint), "number").alias("url"))


def stated_ids(query: Column, prefix: str = "PMC") -> Column:
    """The ids of a query that holds nothing but ids and separators, else null: then it is a search."""
    rest = F.regexp_replace(query, f"(?i){prefix}\\d+|[\\s,;]+", "")
    found = F.regexp_extract_all(F.upper(query), F.lit(f"{prefix}(\\d+)"), F.lit(1))
    return F.when((rest == "") & (F.size(found) > 0), found)


def content_numbers(query: Column) -> Column:
    """The content numbers of a query."""
    return F.regexp_extract_all(query, F.lit("(\\d+)"), F.lit(1))


def hidden_files(listings: DataFrame, post: str, file_pattern: str = "\\.pdf$", title_pattern: str = "") -> DataFrame:
    """Rows (list_id, user_file, system_file, title_id, file_id, title) of a listing's hidden inputs.

    ``post`` is the pattern of a post: title id, title. A file without a post has the title ''.
    """
    # the four inputs of a file follow each other; a file that lacks one is none
    hidden = lambda name: f'id="{name}\\d*"\\s+value="([^"]*)"\\s*/?>'
    form = hidden("userFileName") + "".join('\\s*<input[^>]*?' + hidden(name) for name in ("systemFileName", "titleId", "fileId"))
    group = lambda k, name: F.regexp_extract_all("html", F.lit(form), F.lit(k)).alias(name)
    both = F.arrays_zip(group(1, "user_file"), group(2, "system_file"), group(3, "title_id"), group(4, "file_id"))
    files = listings.select("list_id", F.explode(both).alias("f")).select("list_id", "f.*")
    posts = F.arrays_zip(F.regexp_extract_all("html", F.lit(post), F.lit(1)).alias("title_id"), F.regexp_extract_all("html", F.lit(post), F.lit(2)).alias("title"))
    titles = listings.select("list_id", F.explode(posts).alias("p")).groupBy("list_id", "p.title_id").agg(F.first("p.title").alias("title")).select("list_id", "title_id", plain_text(F.col("title")).alias("title"))
    named = files.join(titles, ["list_id", "title_id"], "left").withColumn("title", F.coalesce("title", F.lit("")))
    return named.filter(F.col("user_file").rlike(f"(?i){file_pattern}") & F.col("title").rlike(title_pattern))


def attachments(pages: DataFrame, pattern: str, most: int = MOST_FILES) -> DataFrame:
    """Rows (page_id, url): the page's stated PDF, else its first links that match."""
    stated = F.regexp_extract("html", '(?is)<meta\\s[^>]*name="citation_pdf_url"[^>]*content="([^"]+)"', 1)
    meta = pages.select("page_id", stated.alias("url")).filter("url <> ''")
    listed = links(pages.join(meta.select("page_id"), "page_id", "left_anti"), pattern)
    first = listed.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "url"))), 1, most).alias("l"))
    return meta.unionByName(first.select("page_id", F.explode("l").alias("x")).select("page_id", "x.url"))


def board_files(lists: DataFrame, posts: DataFrame, detail: str, file_pattern: str, title_filter: str = "", most: int = MOST_FILES) -> DataFrame:
    """Rows (page_id, post_url, title, url): the files of the posts that a board's lists link to.

    ``lists``: page_id, url, html of the list pages. ``posts``: url, html of the posts that were fetched.
    """
    linked = links(lists, detail, title_filter).select("page_id", F.col("url").alias("post_url"), F.col("label").alias("title"))
    known = posts.withColumn("page_id", F.xxhash64("url"))
    files = attachments(known, file_pattern, most).join(known.select("page_id", F.col("url").alias("post_url")), "page_id").drop("page_id")
    return linked.join(files, "post_url").select("page_id", "post_url", "title", "url")


def parse_fetched(fetched: DataFrame, kind: str, **how) -> DataFrame:
    """What is made of a kind's fetched pages (page_id, url, html): files to fetch, or texts. An unknown kind is an error.

    page: attachments. html: title and main text. pmc, kdca: texts of XML. khepi: files of hidden inputs. pdf: itself.
    ``board`` needs the posts too: ``board_files``.
    """
    xml = lambda: fetched.select(F.col("page_id").alias("doc"), F.col("html").alias("xml"))
    if kind == "pdf":
        return fetched.select("page_id", "url")
    if kind == "page":
        return attachments(fetched, how.get("pattern", "\\.(pdf|hwpx?)"), how.get("most", MOST_FILES))
    if kind == "html":
        return fetched.select("page_id", "url", title(F.col("html")).alias("title")).join(main_text(fetched, how.get("selector")), "page_id")
    if kind == "pmc":
        return article_texts(xml())
    if kind == "kdca":
        return portal_texts(xml())
    if kind == "khepi":
        return hidden_files(fetched.withColumnRenamed("page_id", "list_id"), how["post"], how.get("pattern", "\\.pdf$"), how.get("title_filter", ""))
    raise ValueError(f"no kind {kind}")


def parse_mixed(fetched: DataFrame, hows: dict[str, dict] | None = None) -> DataFrame:
    """What is made of fetched files of all kinds at once: rows (key, kind, what, url, title, text, error).

    ``fetched``: key (long), kind, url, html. ``what``: a file to fetch (url), a text, or an error: an unknown kind, a null
    page, XML that isn't what its kind says. An error is a row like another, and no page stops the rest. ``hows`` has the
    settings of kinds for ``parse_fetched``.
    """
    hows = hows or {}
    none = lambda name: F.lit(None).cast("string").alias(name)
    known = F.coalesce(F.col("kind").isin("pdf", "page", "html", "pmc", "kdca", *(["khepi"] if "khepi" in hows else [])), F.lit(False))
    bad = F.when(~known, F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("")))).when(F.col("html").isNull() & (F.col("kind") != "pdf"), "nothing was fetched")
    marked = fetched.select("key", "kind", "url", "html", bad.alias("error"))
    out = marked.filter("error is not null").select("key", "kind", F.lit("error").alias("what"), none("url"), none("title"), none("text"), "error")
    good = marked.filter("error is null").select(F.col("key").alias("page_id"), "kind", "url", "html")
    for kind in ("pdf", "page", "html", "pmc", "kdca", *(["khepi"] if "khepi" in hows else [])):
        made = parse_fetched(good.filter(F.col("kind") == kind).drop("kind"), kind, **hows.get(kind, {}))
        said = lambda name: F.col(name) if name in made.columns else none(name)  # noqa: B023, E731
        key = F.col("page_id" if "page_id" in made.columns else "list_id" if "list_id" in made.columns else "doc")
        url = F.col("system_file") if kind == "khepi" else said("url")
        what = F.lit("file") if kind in ("pdf", "page", "khepi") else F.when(F.col("text").isNotNull(), "text").otherwise("error")
        error = F.coalesce(said("error"), F.when(what == "error", "no article")) if kind in ("pmc", "kdca") else none("error")
        out = out.unionByName(made.select(key.alias("key"), F.lit(kind).alias("kind"), what.alias("what"), url.alias("url"), said("title").alias("title"), said("text").alias("text"), error.alias("error")))
    return out


def page_plan(pages: DataFrame) -> DataFrame:
    """Rows (doc, n_pages, n_empty, recognise, n_ocr) for pages (doc, page, n_chars, ocr_chars).

    Empty pages are recognised only if the file isn't a scan altogether; recognised text counts from 100 characters.
    """
    empty = F.col("n_chars") < EMPTY_CHARS
    sums = pages.groupBy("doc").agg(F.count("*").alias("n_pages"), F.count_if(empty).alias("n_empty"), F.count_if(empty & (F.col("ocr_chars") >= LEAST_OCR)).alias("n_ocr"))
    recognise = (F.col("n_empty") > 0) & (F.col("n_empty") / F.col("n_pages") < SCAN_SHARE)
    return sums.withColumn("recognise", recognise).withColumn("n_ocr", F.when(F.col("recognise"), F.col("n_ocr")).otherwise(F.lit(0)))
