"""From page texts to an index: units of a document (K8), section packing over units (K12), the chunk builder (K13) and the index (V5)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, filter_after, normalise, running, settled, strip, tags
from ..sources.sinks import checkpointed, small_batches
from . import chunking, models
from .textclean import kept_lines, lines_of, page_offset, repeated_edges, sections, with_paragraphs, without_noise

#: Formats whose places are sections instead of pages.
SECTIONED = ("pmc", "kdca")
#: 64 pages are packed at once.
RUN_BITS = 6
UNITS = ["doc_id", "sectioned", "page", "label", "section", "paras", "ocr"]


def parse_units(docs: DataFrame, pages: DataFrame, skip: str) -> DataFrame:
    """K8: rows of UNITS from docs (doc_id, format) and pages (doc_id, page, text, ocr).

    A document of a sectioned format, or whose first page is 0, has its sections (K7) as units, numbered from 1. Any
    other has its pages: recognised ones without noise (K6), all normalised and without edges (K1, K2, K4), as
    paragraphs (K5), with the printed page number (K3) as the label. Units without paragraphs go, but keep their number.
    """
    first = pages.groupBy("doc_id").agg(F.min("page").alias("first_page"))
    kinds = docs.join(first, "doc_id").select("doc_id", "first_page", (F.col("format").isin(*SECTIONED) | (F.col("first_page") == 0)).alias("sectioned"))
    placed = pages.select("doc_id", "page", "text", F.coalesce("ocr", F.lit(False)).alias("ocr")).join(kinds, "doc_id")
    found = sections(placed.filter("sectioned and page = first_page"), skip)
    spaced = F.filter(F.transform(lines_of(F.col("body")), lambda x: strip(F.regexp_replace(x, f"[{SPACE}]+", " "))), lambda x: x != "")
    by_section = found.select("doc_id", F.lit(True).alias("sectioned"), F.col("kept_no").alias("page"), F.col("title").alias("label"), F.col("title").alias("section"), settled(spaced).alias("paras"), F.lit(False).alias("ocr"))
    paged = placed.filter("not sectioned").select(F.col("doc_id").alias("doc"), "page", "text", "ocr")
    edges = repeated_edges(paged).groupBy("doc").agg(F.collect_set("line").alias("edges"))
    joined = paged.join(edges, "doc", "left").join(page_offset(paged), "doc").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))
    clean = joined.withColumn("clean", settled(normalise(F.when(F.col("ocr"), without_noise(F.col("text"), F.col("edges"))).otherwise(F.col("text")))))
    lined = with_paragraphs(clean.withColumn("lines", settled(kept_lines(F.col("clean"), F.col("edges")))), "lines", "paras")
    by_page = lined.select(F.col("doc").alias("doc_id"), F.lit(False).alias("sectioned"), F.col("page").cast("long").alias("page"), (F.col("page") + F.col("page_offset")).cast("string").alias("label"), F.lit("").alias("section"), "paras", "ocr")
    return by_section.unionByName(by_page).filter(F.size("paras") > 0)


def _summary(n: list[int], heading: list[bool], fresh: list[bool]) -> tuple[list[int], list[int], list[int], int]:
    """What a run of paragraphs makes of the size that it starts with: (bounds, sizes, starts, total).

    Until a group starts only sums count, so the first start is the first paragraph whose bound the starting size reaches.
    ``bounds`` falls; a starting size takes the first bound that it reaches, and ends with that one's size after so many
    starts. Below all bounds it grows by ``total``.
    """
    bounds, sizes, starts, before = [], [], [], 0
    for k, (chars, is_heading, is_fresh) in enumerate(zip(n, heading, fresh)):
        bound_ = 0 if is_fresh else max(chunking.SECTION_LEAST - before, 0 if is_heading else chunking.SECTION_SIZE + 1 - before - chars, 0)
        before += chars
        if not bounds or bound_ < bounds[-1]:
            size, count = chars, 1
            for later in range(k + 1, len(n)):
                if fresh[later] or (size >= chunking.SECTION_LEAST and (heading[later] or size + n[later] > chunking.SECTION_SIZE)):
                    size, count = 0, count + 1
                size += n[later]
            bounds.append(bound_)
            sizes.append(size)
            starts.append(count)
        if bounds[-1] == 0:
            break
    return bounds, sizes, starts, sum(n)


def _carried(runs: DataFrame) -> DataFrame:
    """Rows (doc_id, run, size, no, head) of runs (doc_id, run, n, heading, fresh, head): what each starts with.

    Runs are summed up each by itself; then a document's summaries, not its texts, are read in order, one at a time.
    """
    kind = runs.schema["doc_id"].dataType.simpleString()
    small_batches(runs.sparkSession)

    def sum_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [_summary(*lists) for lists in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)))]
            columns = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, pa.array([f[3] for f in found], pa.int64()), part.column(5)], ["doc_id", "run", "bounds", "sizes", "starts", "total", "head"])

    def carry(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, begun, state = None, False, (0, 0, None)
        for part in parts:
            out = []
            for doc_id, _, bounds, sizes, starts, total, head in zip(*(c.to_pylist() for c in part.columns)):
                if not begun or doc_id != doc:
                    doc, begun, state = doc_id, True, (0, 0, None)
                out.append(state)
                at = next((k for k, least in enumerate(bounds) if state[0] >= least), None)
                size, no = (state[0] + total, state[1]) if at is None else (sizes[at], state[1] + starts[at])
                state = (size, no, state[2] if head is None else head)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([s[k] for s in out], type_) for k, type_ in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "run", "size", "no", "head"])

    summed = runs.select("doc_id", "run", "n", "heading", "fresh", "head").mapInArrow(sum_up, f"doc_id {kind}, run long, bounds array<long>, sizes array<long>, starts array<long>, total long, head string")
    return summed.repartition("doc_id").sortWithinPartitions("doc_id", "run").mapInArrow(carry, f"doc_id {kind}, run long, size long, no long, head string")


def section_groups(units: DataFrame) -> DataFrame:
    """Rows (doc_id, group_no, page, page_end, label, pages, section, ocr, sectioned, body) of units.

    Paragraphs of a document are packed over its pages: a heading, or a paragraph that goes past the size, starts a
    group once the one before has 150 characters. A sectioned document starts one at each unit and has no other
    headings. A group's label is its first and last page's, its section the last heading up to its end.

    A document's pages are never one row: they are packed in runs of RUN pages, each from the size that the runs before
    leave (``_carried``), and only a group's own paragraphs come together.
    """
    heading = lambda p: chunking.is_heading(p) & ~F.col("sectioned")
    each = F.transform("paras", lambda p, i: F.struct(F.col("page").alias("page"), i.alias("i"), F.col("label").alias("label"), F.col("section").alias("section"), F.col("ocr").alias("ocr"), p.alias("p"), F.length(p).alias("n"), heading(p).alias("h"), (F.col("sectioned") & (i == 0)).alias("fresh")))
    placed = units.select("doc_id", "sectioned", F.shiftright(F.col("page").cast("long"), RUN_BITS).alias("run"), settled(each).alias("items"))
    runs = placed.groupBy("doc_id", "run").agg(F.bool_or("sectioned").alias("sectioned"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.get("items", F.lit(0))["page"].alias("page"), "items"))), lambda u: u["items"])).alias("items"))
    of = lambda c: F.transform("items", lambda x: x[c]).alias(c if c != "h" else "heading")
    head = F.element_at(F.filter("items", lambda x: x["h"]), -1)["p"]
    runs = checkpointed(runs.withColumn("items", settled(F.col("items"))).withColumn("head", F.when(F.exists("items", lambda x: x["h"]), head)))
    carried = _carried(runs.select("doc_id", "run", of("n"), of("h"), of("fresh"), "head"))

    def step(a: Column, x: Column) -> Column:
        new = x["fresh"] | ((a["size"] >= chunking.SECTION_LEAST) & (x["h"] | (a["size"] + x["n"] > chunking.SECTION_SIZE)))
        return F.struct(F.when(new, x["n"]).otherwise(a["size"] + x["n"]).alias("size"), (a["no"] + F.when(new, 1).otherwise(0)).alias("no"), F.when(x["h"], x["p"]).otherwise(a["head"]).alias("head"))

    started = runs.drop("head").join(carried, ["doc_id", "run"])
    states = running(F.col("items"), F.struct("size", "no", "head"), step, "struct<size:bigint,no:bigint,head:string>")
    stated = started.withColumn("states", settled(states))
    rows = stated.select("doc_id", "sectioned", F.explode(F.arrays_zip("items", "states")).alias("x")).select("doc_id", "sectioned", (F.col("x.states.no") - F.when(F.col("sectioned"), 1).otherwise(0)).alias("group_no"), F.struct("x.items.page", "x.items.i", "x.items.label", "x.items.section", "x.items.p", "x.states.head").alias("item"), "x.items.ocr")
    groups = rows.groupBy("doc_id", "sectioned", "group_no").agg(F.array_sort(F.collect_list("item")).alias("own"), F.bool_or("ocr").alias("ocr"))
    ends = groups.select("doc_id", "sectioned", F.col("group_no").cast("int").alias("group_no"), "ocr", settled(F.col("own")).alias("own")).withColumns({"first": F.get("own", F.lit(0)), "last": F.element_at("own", -1)})
    section = F.when(F.col("sectioned"), F.col("first.section")).otherwise(F.coalesce(F.substring(F.regexp_replace(F.col("last.head"), "^#+\\s*", ""), 1, chunking.TITLE_CUT), F.lit("")))
    label = F.when((F.col("first.label") == F.col("last.label")) | F.col("sectioned"), F.col("first.label")).otherwise(F.concat("first.label", F.lit("-"), "last.label"))
    body = strip(F.array_join(F.transform("own", lambda x: x["p"]), "\n"))
    told = ends.select("doc_id", "sectioned", "group_no", F.col("first.page").alias("page"), F.col("last.page").alias("page_end"), label.alias("label"), F.array_distinct(F.transform("own", lambda x: x["label"])).alias("pages"), section.alias("section"), "ocr", settled(body).alias("body"))
    return filter_after(told, F.col("body") != "")


def build_chunks(docs: DataFrame, units: DataFrame, strategy: str, doc_tags: dict[str, str], group_tags: dict[str, str]) -> DataFrame:
    """The chunks of a strategy (fixed, fixed_ctx, section_ctx) with ids, places, recognised-text flags and tags.

    ``docs``: doc_id, title, lang, doc_type. Diseases are tags of the title, groups those of the chunk's text.
    """
    named = units.join(docs.select("doc_id", "title", "lang", "doc_type"), "doc_id")
    if strategy == "section_ctx":
        groups = section_groups(units).join(docs.select("doc_id", "title", "lang", "doc_type"), "doc_id")
        size, body = chunking.SECTION_SIZE, F.col("body")
    elif strategy in ("fixed", "fixed_ctx"):
        groups = named.select("*", F.lit(0).alias("group_no"), F.col("page").alias("page_end"), F.array("label").alias("pages"))
        size, body = chunking.FIXED_SIZE, F.array_join("paras", "\n")
    else:
        raise ValueError(f"no strategy {strategy}")
    head = F.lit("") if strategy == "fixed" else chunking.context_header(F.col("title"), F.col("section"), F.col("label"), F.col("sectioned"))
    kept = ["doc_id", "title", "lang", "doc_type", "page", "page_end", "label", "pages", "section", "ocr", "group_no"]
    cut = groups.select(*kept, head.alias("head"), settled(body).alias("body")).withColumn("pieces", settled(chunking.windows(F.col("body"), size)))
    each = cut.select(*kept, "head", F.posexplode("pieces").alias("piece_no", "piece"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "group_no", "piece_no"))
    text = each.withColumn("chunk_id", F.format_string("%s#%04d", F.col("doc_id").cast("string"), no)).withColumn("text", F.concat("head", "piece"))
    return text.select(F.lit(strategy).alias("strategy"), "chunk_id", *kept[:-1], tags(F.col("title"), doc_tags).alias("diseases"), tags(F.col("text"), group_tags).alias("groups"), "text")


def build_index(chunks: DataFrame, cache: DataFrame, name: str, model: models.Embed = models.hash_embedder) -> tuple[DataFrame, DataFrame]:
    """V5: (the index, the cache after it): chunks with their unit vectors, each distinct text embedded once, and only if the cache (key, vec) lacks it."""
    from .vector import l2_normalise

    fresh = checkpointed(models.embed(models.cache_misses(chunks.select("text"), cache, name), model))
    known = models.cache_upsert(cache, fresh)
    keyed = chunks.withColumn("key", models.cache_key(name, F.col("text")))
    vectors = known.select("key", l2_normalise(F.col("vec")).alias("vector"))
    return keyed.join(vectors, "key").drop("key"), known
