"""Banded signatures against the prefix join and plain sets, families over several blocks, walks and rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import dedup
from ragloom.operators import shingles as S

DOCS = "doc_id long, lang string, text string, node int, call int"


def plain_pairs(rows, least, size=10):
    sets = {}
    for doc_id, lang, text in rows:
        bare = "".join(c for c in text or "" if not (c.isspace() or c in "\x1c\x1d\x1e\x1f"))
        if doc_id is not None and lang is not None and len(bare) >= size:
            key = (lang, frozenset(bare[k : k + size] for k in range(len(bare) - size + 1)))
            sets[key] = min(doc_id, sets.get(key, doc_id))
    every = sorted((i, lang, s) for (lang, s), i in sets.items())
    return {(a, b, len(s & t), round(len(s & t) / len(s | t), 9)) for k, (a, la, s) in enumerate(every) for b, lb, t in every[k + 1 :] if la == lb and len(s & t) >= least * len(s | t)}


def family(rng, n, words=120):
    """Edited copies of one text, from a word changed to half of them."""
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    for _ in range(n):
        mine, share = list(base), rng.choice([0, 0.01, 0.02, 0.05, 0.1, 0.5])
        for k in range(words):
            if rng.random() < share:
                mine[k] = rng.choice(vocabulary)
        yield " ".join(mine[: rng.choice([words, words, words - 15, words // 2])])


def found(df):
    return {(r.a, r.b, r.inter, round(r.jaccard, 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [t for size in (150, 12, 3, 2) for t in family(rng, size)] + [" ".join([*w[:k], "new", *w[k:]]) for w in [next(family(rng, 1, 600)).split()] for k in (1, 100, 250, 251, 299)] + [None, "", "short", "a b c d e f g h i j", "a  b c d e f g h i j", "x" * 400, "x" * 11, "　é😀" * 30]
    rng.shuffle(texts)
    return [(k if k != 5 else None, rng.choice(["en", "en", "en", "de", None]), t) for k, t in enumerate(texts)] + [(7, "en", texts[7])]


@pytest.mark.parametrize("least", [0.6, 0.8, 0.98])
def test_pairs_against_plain_sets_and_the_prefix_join(spark, rows, least):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS).repartition(5)
    expected = plain_pairs(rows, least)
    assert found(dedup.jaccard_pairs(docs, least)) == expected and len(expected) > (20 if least < 0.9 else 1)
    # the prefix join names a class of a null id so, too
    assert found(dedup.prefix_pairs(docs.filter("doc_id is not null"), least)) == expected


def test_no_rows_make_no_pairs(spark):
    assert dedup.jaccard_pairs(spark.createDataFrame([], DOCS)).count() == 0
    assert dedup.class_members(spark.createDataFrame([], DOCS)).count() == 0


def test_class_members_are_equal_sets_of_a_language(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS)
    members = {}
    for doc_id, lang, text in rows:
        bare = "".join((text or "").split())
        if len(bare) >= 10:
            members.setdefault((lang, frozenset(bare[k : k + 10] for k in range(len(bare) - 9))), []).append(doc_id)
    expected = sorted(str((d, min(x for x in own if x is not None))) for own in members.values() if any(x is not None for x in own) for d in own)
    assert sorted(str((r.doc_id, r.class_id)) for r in dedup.class_members(docs).filter("class_id is not null").collect()) == expected


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(5)
    for least in (0.6, 0.98):
        cut = S.plan(least, 100_000)
        n, missed, agree = 3000, 0, []
        other = round(n * (1 - least) / (1 + least))
        for _ in range(60):
            every = rng.integers(0, 1 << 63, n + other, dtype=np.uint64) * np.uint64(2)
            a, b = S.signature(np.sort(every[:n]), cut.values), S.signature(np.sort(every[other:]), cut.values)
            agree.append((a == b).sum())
            missed += not np.intersect1d(S.bands(a, cut, "en"), S.bands(b, cut, "en")).size
            assert not np.intersect1d(S.bands(a, cut, "en"), S.bands(a, cut, "de")).size
        assert missed == 0 and min(agree) >= cut.agree
        assert abs(np.mean(agree) / cut.values - least) < 0.05
    assert S.plan(0.6, 10**9).rows > S.plan(0.6, 1000).rows


def test_intersections_are_counted_in_products_and_one_by_one():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))) for _ in range(20)]
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20)]
    plain = [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    assert dedup._intersections(sets, pairs) == plain
    assert dedup._intersections(sets, pairs[:7]) == plain[:7]


@pytest.mark.parametrize("most", [0, 12, 10**6])
def test_exclusion_by_walks_and_by_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "CALL_EDGES", max(1, most))
    rng = random.Random(most)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(30)} | {tuple(sorted(rng.sample(range(50, 56), 2))) for _ in range(14)}
    by = {}
    for b in range(60):
        if first := [a for a in sorted(x for x, y in edges if y == b) if by[a] is None]:
            by[b] = first[0]
        else:
            by[b] = None
    live = spark.createDataFrame([(k,) for k in range(60)], "doc_id long")
    pairs = spark.createDataFrame([(a, b, 0.99) for a, b in edges] + [(1, 2, 0.97), (3, 999, 1.0)], "a long, b long, jaccard double")
    assert {r.doc_id: r.excluded_by for r in dedup.content_exclusion(live, pairs).collect()} == by


def test_long_sets_of_copies_go_through_once(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.expr("repeat('all work and no play makes a dull text 0123456789 ', 50)"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("end of number "), F.col("id").cast("string"))).otherwise("")).alias("text"))
    pairs = dedup.jaccard_pairs(docs, 0.5)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in (0, 1, 10, 20, 30) for b in (0, 1, 10, 20, 30) if a < b}


@pytest.mark.parametrize("most", [0, 9000, 10**9])
def test_copies_are_excluded_as_by_all_pairs(spark, rows, monkeypatch, most):
    """In one call, in several, and by pairs."""
    monkeypatch.setattr(dedup, "WALK_SHINGLES", max(1, most))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS).repartition(5)
    members, pairs = dedup.classes_and_pairs(docs, 0.8)
    live = members.filter("doc_id = class_id").select("doc_id").distinct()
    expected = sorted(map(str, dedup.content_exclusion(live, pairs, 0.8).collect()))
    assert sorted(map(str, dedup.copies_excluded(docs, 0.8).collect())) == expected
    assert sum("None" not in x for x in expected) > 20


def test_counts_are_those_of_plain_sets(spark, rows):
    """a text's n-grams are counted in numpy, not as arrays of characters."""
    bare = {k: "".join(c for c in text or "" if not (c.isspace() or c in "\x1c\x1d\x1e\x1f")) for k, (_, _, text) in enumerate(rows)}
    docs = spark.createDataFrame([(k, "en", text, 1, 2) for k, (_, _, text) in enumerate(rows)], DOCS)
    assert {r.doc_id: r.n for r in dedup.shingle_counts(docs).collect()} == {k: len({t[i : i + 10] for i in range(len(t) - 9)}) for k, t in bare.items()}


def test_small_components_are_walked_in_many_calls(spark, monkeypatch):
    """as many calls as WALK_CALL asks for, whatever a component may have at most."""
    rng = random.Random(8)
    texts = [t for _ in range(30) for t in [" ".join(str(rng.random()) for _ in range(40))] for t in (t, t + " x", t + " yz")]
    docs = spark.createDataFrame([(k, "en", t, 1, 2) for k, t in enumerate(texts)], DOCS)
    expected = sorted(dedup.copies_excluded(docs, 0.9).collect(), key=str)
    assert sum(r.excluded_by is not None for r in expected) >= 60
    monkeypatch.setattr(dedup, "WALK_CALL", 3000)
    found, classes, _, cut, _ = dedup._read(docs, 0.9, 10)
    walked = dedup._walked(dedup._components(found, classes), docs, classes, cut, 0.9, 10)
    assert walked._jdf.queryExecution().analyzed().toString().count("pmod(xxhash64(root") == 1
    assert int(walked._jdf.queryExecution().analyzed().toString().split("pmod(xxhash64(root")[1].split("cast(")[1].split(" as")[0]) > 10
    assert sorted(dedup.copies_excluded(docs, 0.9).collect(), key=str) == expected


def test_bands_are_shuffled_once(spark, rows, monkeypatch):
    """F9, F10, F11."""
    seen = []
    plain = dedup.components
    monkeypatch.setattr(dedup, "components", lambda edges: seen.append(edges) or plain(edges))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS)
    assert found(dedup.jaccard_pairs(docs)) == plain_pairs(rows, 0.6)
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(spot") == 1
