"""Packing over pages in runs, against a plain walk over a document's paragraphs."""

import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import building, chunking
from ragloom.operators.textclean import HEADING

UNITS = "doc_id string, sectioned boolean, page long, label string, section string, paras array<string>, ocr boolean"


def plain_groups(units):
    """(group_no, page, page_end, label, pages, section, ocr, body) of one document's units in order."""
    out, size, head, sectioned = [], 0, "", units[0][1]
    for _, _, page, label, section, paras, ocr in sorted(units, key=lambda u: u[2]):
        for i, p in enumerate(paras):
            heading = not sectioned and p.startswith("# ") and len(p) <= chunking.HEADING_MOST
            if not out or (sectioned and i == 0) or (size >= chunking.SECTION_LEAST and (heading or size + len(p) > chunking.SECTION_SIZE)):
                out.append([page, page, [], section, False, [], ""])
                size = 0
            size += len(p)
            head = p.lstrip("# ")[: chunking.TITLE_CUT] if heading else head
            g = out[-1]
            g[1], g[4], g[6] = page, g[4] or ocr, head
            g[2] += [label] if label not in g[2] else []
            g[5].append(p)
    told = [(k, a, b, labels[0] if sectioned or labels[0] == labels[-1] else f"{labels[0]}-{labels[-1]}", labels, section if sectioned else at, ocr, "\n".join(ps).strip()) for k, (a, b, labels, section, ocr, ps, at) in enumerate(out)]
    return [t for t in told if t[-1]]


def paragraph(rng):
    kind = rng.random()
    if kind < 0.15:
        return "# " + "Title of it " * rng.randrange(1, 4)
    return "x" * rng.choice([1, 20, 140, 149, 150, 151, 400, 750, 751, 899, 900, 1200]) if kind < 0.9 else " "


@pytest.mark.parametrize("pages", [3, 200])
def test_groups_are_those_of_a_walk(spark, pages):
    assert "#" in HEADING
    rng = random.Random(pages)
    docs = {}
    for d in range(12):
        sectioned = d % 4 == 3
        docs[f"d{d}"] = [(f"d{d}", sectioned, p * (1 if d % 2 else 40), str(p // 2), f"s{p}" if sectioned else "", [paragraph(rng) for _ in range(rng.randrange(1, 6))], rng.random() < 0.1) for p in range(1, pages)]
    found = building.section_groups(spark.createDataFrame([u for us in docs.values() for u in us], UNITS).repartition(5)).collect()
    for d, units in docs.items():
        mine = sorted((r.group_no, r.page, r.page_end, r.label, r.pages, r.section, r.ocr, r.body) for r in found if r.doc_id == d)
        assert mine == plain_groups(units)


def test_a_run_tells_what_it_makes_of_every_size():
    rng = random.Random(1)
    for _ in range(300):
        n = [rng.choice([0, 1, 100, 149, 150, 400, 901, 1500]) for _ in range(rng.randrange(12))]
        heading = [rng.random() < 0.2 for _ in n]
        fresh = [rng.random() < 0.05 for _ in n]
        bounds, sizes, starts, total = building._summary(n, heading, fresh)
        for first in (0, 1, 50, 149, 150, 151, 500, 751, 899, 900, 901, 5000):
            size, count = first, 0
            for chars, h, f in zip(n, heading, fresh):
                if f or (size >= chunking.SECTION_LEAST and (h or size + chars > chunking.SECTION_SIZE)):
                    size, count = 0, count + 1
                size += chars
            at = next((k for k, least in enumerate(bounds) if first >= least), None)
            assert (size, count) == ((first + total, 0) if at is None else (sizes[at], starts[at]))


def test_a_document_of_a_hundred_thousand_pages(spark):
    units = spark.range(100_000).select(F.lit("long").alias("doc_id"), F.lit(False).alias("sectioned"), F.col("id").alias("page"), F.col("id").cast("string").alias("label"), F.lit("").alias("section"), F.array(F.expr("repeat('y', cast(100 + id % 7 as int))"), F.when(F.col("id") % 1000 == 0, F.lit("# A title")).otherwise("z")).alias("paras"), F.lit(False).alias("ocr"))
    told = building.section_groups(units).agg(F.count("*").alias("n"), F.max("group_no").alias("last"), F.sum(F.length("body")).alias("chars"), F.max(F.length("body")).alias("most")).first()
    size, groups = 0, 1
    for k in range(100_000):
        for chars, heading in ((100 + k % 7, False), (9, True) if k % 1000 == 0 else (1, False)):
            if size >= 150 and (heading or size + chars > 900):
                size, groups = 0, groups + 1
            size += chars
    assert told.n == told.last + 1 == groups and told.most < 920


def test_no_units_make_no_groups(spark):
    assert building.section_groups(spark.createDataFrame([], UNITS)).count() == 0
