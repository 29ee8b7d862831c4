"""Operator 13 against measuring every entry, and its query against its SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

from ragloom.llm import codes, registry

from tests.oracle import compare, connect

SCHEMA = "vec_id long, label int, vector array<float>, code int, error string"


def plain(rows, parts, entries, rounds, scale=256):
    """(codes, errors, books) of rows (vec_id, label, vector) by measuring all entries."""
    kept = [r for r in rows if r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    whole = [[math.floor(scale * float(np.float32(x))) for x in r[2]] for r in kept]
    size = len(whole[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in whole]
    first = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][2]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: [min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        found = [nearest(v) for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                if own := [cut[k][p] for k in range(len(cut)) if found[k][p] == e]:
                    after = [sum(x) // len(own) for x in zip(*own)]
                    found_book = books[p]
                    found_book[e] = after
    found = [nearest(v) for v in cut]
    errors = [sum(far(v[p], books[p][f[p]]) for p in range(parts)) for v, f in zip(cut, found)]
    return [(r[0], r[1], f, e) for r, f, e in zip(kept, found, errors)], books


def made(n, size, seed=1):
    rng = random.Random(seed)
    some = [[rng.choice([0.0, 0.25, -0.25, 0.5, rng.gauss(0, 1)]) for _ in range(size)] for _ in range(n // 2)]
    rows = [(rng.randrange(-5, n), rng.choice([None, 1, 2]), rng.choice(some) if rng.random() < 0.5 else [rng.gauss(0, 0.3) for _ in range(size)]) for _ in range(n)]
    bad = [(1, 1, None), (2, 1, []), (3, 1, [None] * size), (-9, 1, [math.nan] * size), (-8, 1, [math.inf] + [0.0] * (size - 1)), (None, None, [0.1] * size)]
    return rows + bad + rows[:3]


def test_nearest_is_that_of_all_entries():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 7, 64):
        for spread in (2, 5, 300):  # small spreads make ties of distance and of norm
            entries, points = rng.integers(-spread, spread, (k, 4)), rng.integers(-spread, spread, (500, 4))
            d = ((points[:, None] - entries[None]) ** 2).sum(2)
            found = codes.Annulus(entries).nearest(points)
            assert (found[0] == d.argmin(1)).all() and (found[1] == d.min(1)).all()
    assert [len(x) for x in codes.Annulus(entries).nearest(points[:0])] == [0, 0]


def test_annulus_leaves_entries_out():
    rng = np.random.default_rng(3)
    for size, share in ((1, 0.35), (2, 0.5), (4, 0.85)):  # what norms tell falls with the number of components
        entries, points = rng.integers(-200, 200, (64, size)), rng.integers(-200, 200, (2000, size))
        book = codes.Annulus(entries)
        book.nearest(points)
        assert book.measured < share * 64 * 2000


@pytest.mark.parametrize("parts,entries,rounds", [(2, 4, 2), (4, 300, 1), (1, 1, 3), (4, 8, 0)])
def test_codes_against_all_entries(spark, parts, entries, rounds):
    rows = made(120, 8)
    vectors = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    books = codes.fit(vectors, parts, entries, rounds)
    expected, plain_books = plain(rows, parts, entries, rounds)
    assert books.tolist() == plain_books
    found = codes.encode(vectors.select("vec_id", "label", "vector"), books).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), list(r[2]), r[3])
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert len(codes.decode(found[0].code, books)) == 8


def test_small_and_wrong_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    books = codes.fit(none)
    assert books.shape == (16, 0, 0) and codes.encode(none.select("vec_id", "label", "vector"), books).count() == 0
    for vectors in ([[0.0] * 7], [[0.0] * 16, [0.0] * 32], [[1e30] * 16]):
        with pytest.raises(Exception, match="cut|lengths|too large"):
            codes.encode(df := spark.createDataFrame([(k, 1, v, 0, "") for k, v in enumerate(vectors)], SCHEMA).coalesce(1), codes.fit(df)).collect()


def test_query_of_broken_rows(spark, tmp_path):
    rows = made(200, 16, 5)
    spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).withColumnRenamed("vector", "embedding").repartition(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = registry.queries()["op13_vector_codes"](spark, str(tmp_path)).collect()
    expected, books = plain(rows, 16, 64, 2)
    by_label = {label: sum(r[3] for r in expected if r[1] == label) for label in (None, 1, 2)}
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(map(tuple, found), key=key) == sorted(((r[0], "".join(f"{c:02x}" for c in r[2]), r[3], by_label[r[1]], digest) for r in expected), key=key)


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, registry.queries()["op13_vector_codes"], registry.oracle_sql()["op13_vector_codes"]) is None
