"""Recognition of pages without text (S21, S22): two stages with recognisers that are passed in, and a cache by page and resolution.

Pages with hardly any text are read by a fast recogniser first; only where that finds enough is the page no cover and worth
the precise one. What the cache has isn't recognised again, and each page is given to a stage once. A recogniser that
fails leaves an error beside its page, and nothing in the cache, so that a later run tries again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_chars
from ..sources.sinks import checkpointed, small_batches
from .acquire import EMPTY_CHARS, LEAST_OCR, SCAN_SHARE

#: Dots an inch of the two stages.
FAST, PRECISE = 200, 500
Recognise = Callable[[bytes, int], str]


def wanted_pages(pages: DataFrame) -> DataFrame:
    """The pages (doc, page, text, ...) to recognise: empty ones, of documents that aren't scans altogether."""
    empty = F.coalesce(count_chars(F.col("text")), F.lit(0)) < EMPTY_CHARS
    some = pages.groupBy("doc").agg(F.avg(empty.cast("int")).alias("share")).filter(F.col("share") < SCAN_SHARE).select("doc")
    return pages.filter(empty).join(some, "doc", "left_semi")


def _stage(images: DataFrame, cache: DataFrame, resolution: int, how: Recognise) -> DataFrame:
    """Rows (doc, page, text, error, fresh) of images (doc, page, image): from the cache (doc, page, resolution, text), else recognised."""
    known = cache.filter(F.col("resolution") == resolution).select("doc", "page", "text").dropDuplicates(["doc", "page"])
    small_batches(images.sparkSession)

    def read(image: bytes | None) -> tuple[str | None, str | None]:
        if image is None:
            return None, "no image"
        try:
            return how(image, resolution), None
        except Exception as problem:  # noqa: BLE001
            return None, f"{type(problem).__name__}: {problem}"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [read(image) for image in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], ["doc", "page", "text", "error"])

    kinds = {c: images.schema[c].dataType.simpleString() for c in ("doc", "page")}
    asked = images.select("doc", "page", "image").join(known.select("doc", "page"), ["doc", "page"], "left_anti")
    # written, so that nothing is recognised again when rows are read twice
    fresh = checkpointed(asked.mapInArrow(batches, f"doc {kinds['doc']}, page {kinds['page']}, text string, error string"))
    held = images.select("doc", "page").join(known, ["doc", "page"]).select("doc", "page", "text", F.lit(None).cast("string").alias("error"), F.lit(False).alias("fresh"))
    return fresh.withColumn("fresh", F.lit(True)).unionByName(held)


def recognised(pages: DataFrame, cache: DataFrame, fast: Recognise | None, precise: Recognise | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, cache) after recognition of pages (doc, page, text, image): rows (doc, page, text, ocr, error), and the cache.

    A recognised text counts from LEAST_OCR characters; otherwise the page keeps its own. Without a recogniser, pages stay
    as they are; without a precise one, the fast one reads at both resolutions. Pages are one row each.
    """
    own = pages.select("doc", "page", "text")
    if fast is None:
        return own.withColumns({"ocr": F.lit(False), "error": F.lit(None).cast("string")}), cache
    images = wanted_pages(pages).select("doc", "page", "image")
    first = checkpointed(_stage(images, cache, FAST, fast))
    enough = first.filter(count_chars(F.col("text")) >= LEAST_OCR).select("doc", "page")
    second = checkpointed(_stage(images.join(enough, ["doc", "page"], "left_semi"), cache, PRECISE, precise or fast))
    both = first.select("doc", "page", F.col("text").alias("rough"), F.col("error").alias("rough_error")).join(second.select("doc", "page", F.col("text").alias("fine"), F.col("error").alias("fine_error")), ["doc", "page"], "left")
    read = F.coalesce("fine", "rough")
    good = F.coalesce(count_chars(read) >= LEAST_OCR, F.lit(False))
    told = own.join(both, ["doc", "page"], "left").select("doc", "page", F.when(good, read).otherwise(F.col("text")).alias("text"), good.alias("ocr"), F.coalesce("fine_error", "rough_error").alias("error"))
    new = [rows.filter("fresh and error is null").select("doc", "page", F.lit(resolution).alias("resolution"), "text") for rows, resolution in ((first, FAST), (second, PRECISE))]
    return told, cache.unionByName(new[0]).unionByName(new[1])
