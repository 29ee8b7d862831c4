"""Operator 11 against a plain search of every period, and its query against a plain reading of the contract."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from ragloom.llm import periods, registry


def plain_runs(s, exponent=4, least=6):
    """Every period's stretches of equal words, the least period of each interval."""
    best = {}
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in best.items())


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5), (5, 20)])
def test_runs_are_those_of_every_period(exponent, least):
    rng = random.Random(exponent)
    for _ in range(250):
        kinds, n = rng.choice([1, 2, 2, 3, 6]), rng.randrange(90)
        s = []
        while len(s) < n:
            w = [rng.randrange(kinds) for _ in range(rng.choice([1, 1, 2, 3, 7]))]
            s += w * rng.choice([1, 1, 2, 5, 9])
        if rng.random() < 0.3:  # runs within runs
            s = (s[:9] + s[:1] * 8) * 7 + s
        assert periods.find_runs(np.array(s, np.int64), exponent, least) == plain_runs(s, exponent, least), s


def test_z_function_counts_equal_beginnings():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 120))] * rng.randrange(1, 3)
        expected = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periods.z_function(np.array(s)).tolist() == expected
    assert periods.z_function(np.array([], np.int64)).tolist() == []


def test_long_repetitions_take_little_time():
    began = time.time()
    assert periods.text_runs("a " * 100_000)[1] == [(0, 100_000, 1)]
    n, runs, kept = periods.text_runs(("x y " * 3000 + "z ") * 12)
    assert n == 72_012 and len(runs) == 13 and kept == "x y z"
    assert time.time() - began < 20


def test_edge_rows_of_the_query(spark, edge, tmp_path):
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()["op11_periodic_runs"](spark, str(tmp_path))
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[-1]))
    assert order(found.collect()) == order(plain_row(r.doc_id, r.text) for r in edge.collect())


def test_query_against_plain_rows(spark, sf_dir, documents):
    found = registry.queries()["op11_periodic_runs"](spark, sf_dir)
    assert found.dtypes[1:6] == [(c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(plain_row(r.doc_id, r.text) for r in documents.collect())
    assert sum(r[1] > 0 for r in rows) > 3


def test_operator_gives_texts_and_runs(spark, empty):
    docs = spark.createDataFrame([(1, "well a b a b a b a b end", "n"), (2, None, "n"), (3, "   ", "n")], "doc_id long, text string, runs string")
    rows = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert rows[1].collapsed == "well a b end" and [tuple(r) for r in rows[1].runs] == [(1, 8, 2)] and rows[1].n_words == 10
    assert rows[2].n_words == rows[3].n_words == 0 and rows[3].collapsed == "" and rows[2].runs == []
    assert periods.periodic_runs(docs, exponent=5).filter("size(runs) > 0").count() == 0
    assert periods.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, exponent=1)
