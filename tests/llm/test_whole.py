"""Rules are learned from all labelled rows, and what a sample orders changes no result (F2)."""

import random

import numpy as np
from pyspark.sql import functions as F

from ragloom.llm import nearcopies, quality


def labelled(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.when(F.col("id") % 5 == 0, "# $ #"), F.col("id").cast("string")).alias("text"))
    return docs, spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    docs, labels = labelled(spark, 15_000)
    seen = []
    monkeypatch.setattr(quality, "learn", lambda rows: seen.extend(rows) or [])
    quality.fit(docs, labels)
    assert len(seen) == 15_000 and sum(r["bad"] for r in seen) == 3000


def test_labels_too_many_to_broadcast_give_the_same_rules(spark, monkeypatch):
    docs, labels = labelled(spark, 3000)
    rules = quality.fit(docs, labels)
    assert [[(t.feature, t.over) for t in rule] for rule in rules] == [[("q_symbols", True)]] and 0 < rules[0][0].cut < 0.5
    monkeypatch.setattr(quality, "BROADCAST_IDS", 10)
    assert quality.fit(docs, labels) == rules


def test_counts_on_spark_are_those_of_a_list(spark):
    rng = random.Random(3)
    rows = [{f: rng.choice([0.0, 1.0, 2.5, 7.0, rng.random() * 3]) for f in quality.FEATURES} | {"bad": int(rng.random() < 0.3), "doc_id": k} for k in range(900)]
    table = quality._Table(spark.createDataFrame(rows))
    plain = quality._Rows(rows, 5)
    grow = {r.doc_id: r.grow for r in spark.range(900).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(3)) < 2).alias("grow")).collect()}
    plain.bad, plain.grow = np.array([r["bad"] for r in rows], bool), np.array([grow[k] for k in range(900)])
    plain.values = {f: np.array([r[f] for r in rows]) for f in quality.FEATURES}
    spans = table.spans()
    for f, (bad, every) in spans.items():
        for mine, values in ((bad, plain.values[f][plain.grow & plain.bad]), (every, plain.values[f][plain.grow])):
            assert all(a <= b for a, b in mine) and all(x[1] < y[0] for x, y in zip(mine, mine[1:]))
            assert all(any(a <= v <= b for a, b in mine) for v in values) and {x for span in mine for x in span} <= set(values)
    tests = quality._Tests(spans)
    plain.cut(tests)
    table.cut(tests)
    rules, gone = [(), (3,), (5, 90), (200,)], [(40, 7), (150,)]
    for a, b in zip(plain.by_test(rules, gone), table.by_test(rules, gone), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
    assert plain.by_rule(rules, gone) == table.by_rule(rules, gone)
    k = 17
    held = np.array([tests.tests[k].holds(r) for r in rows]) & plain.grow & plain.bad
    assert plain.by_test([()], [])[0][0][k] == held.sum()


def test_the_order_of_shingles_changes_no_group(spark, monkeypatch):
    """What ``_often`` samples decides which common shingle a pair meets on, not whether it meets."""
    rng = random.Random(6)
    base = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.01 else "x" for w in rng.choice(base)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = sorted(nearcopies.copy_groups(docs).collect())
    assert 12 <= len({g for _, g in groups}) < 120
    every = np.unique(np.concatenate([nearcopies.shingle_set(nearcopies._words(t), 5, nearcopies._WordHashes()) for t in texts]))
    for order in ((np.zeros(0, np.uint64), np.zeros(0, np.int64), len(texts)), (every, np.random.default_rng(1).integers(1, 9, len(every)), len(texts))):
        monkeypatch.setattr(nearcopies, "_often", lambda *_, order=order: order)
        assert sorted(nearcopies.copy_groups(docs).collect()) == groups
