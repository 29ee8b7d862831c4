"""Vector search in blocks, and quotas against a plain greedy pick."""

import random

from ragloom.operators import vector


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_blocks_give_what_a_broadcast_gives(spark, sf_dir, monkeypatch):
    from ragloom.sources import tables

    def found(most):
        monkeypatch.setattr(vector, "MOST_BYTES", most)
        return _rows(vector.topk(vector.fused_scores(tables.chunks(spark, sf_dir), tables.queries(spark, sf_dir)), 5), "query_id", "rank", "chunk_id")

    assert found(64 << 20) == found(3000)


def plain_quota(rows, k, per_doc, academic, public, public_per_doc):
    """Greedy picks for one query's rows (chunk_id, doc, doc_type, score_original, score)."""
    picked, used = [], {}

    def take(pool, n, by, cap):
        for r in sorted(pool, key=lambda r: (-r[by], r[0])):
            if len(picked) >= n:
                return
            if r not in picked and not (cap and used.get(r[1], 0) >= cap):
                used[r[1]] = used.get(r[1], 0) + 1
                picked.append(r)

    if public:
        take([r for r in rows if r[2] == "public"], min(public, k), 3, public_per_doc or per_doc)
    if academic:
        take([r for r in rows if r[2] == "academic"], min(len(picked) + academic, k), 4, per_doc)
    take(rows, k, 4, per_doc)
    return {r[0] for r in picked}


def test_quotas_match_a_greedy_pick(spark):
    r = random.Random(3)
    rows = {q: [(c, f"d{r.randrange(6)}", r.choice(("public", "public", "academic")), r.randrange(30) / 30, r.randrange(30) / 30) for c in range(80)] for q in range(6)}
    df = spark.createDataFrame([(q, *row) for q, each in rows.items() for row in each], "query_id long, chunk_id long, doc string, doc_type string, score_original double, score double")
    for setting in ((10, 2, 0, 5, 1), (10, 2, 3, 5, 1), (8, None, 2, 3, None), (12, 3, 4, 0, None), (5, 1, 0, 9, 2)):
        got = {}
        for x in vector.quota_topk(df, *setting).collect():
            got.setdefault(x.query_id, set()).add(x.chunk_id)
        assert got == {q: plain_quota(each, *setting) for q, each in rows.items()}, setting


def test_best_scores_hold_all_that_limits_let_through(spark, monkeypatch):
    """Ties, equal vectors, broken vectors and exclusions; queries in several groups; every limit's rows are there."""
    monkeypatch.setattr(vector, "GROUP", 3)
    r = random.Random(9)
    some = [[r.choice((0.5, -0.5, 1.0)) for _ in range(4)] for _ in range(9)]
    rows = [(f"c{k:03}", r.choice(("d1", "d2", "d3", None)), r.choice(("public", "academic")), r.choice(some)) for k in range(300)]
    rows += [("x1", "d1", "public", None), ("x2", "d2", "public", [1.0, None, 0.0, 0.0]), ("x3", "d2", "academic", [9.0]), ("x4", "d4", "public", [float("nan")] * 4)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc string, doc_type string, vector array<float>").repartition(5)
    asked = spark.createDataFrame([(q, [r.gauss(0, 1) for _ in range(4)], [r.gauss(0, 1) for _ in range(4)], [f"c{q:03}", "x9"]) for q in range(8)], "query_id long, original array<double>, translated array<double>, exclude array<string>")
    every = vector.fused_scores(chunks, asked)
    columns = ("query_id", "chunk_id", "score", "score_original", "rank")
    told = lambda df: sorted(map(repr, _rows(df, *columns)))
    for setting in ((10, 2, 0, 5, 1), (8, None, 2, 3, None), (12, 3, 4, 0, None)):
        few = vector.best_scores(chunks, asked, vector.quota_limits(*setting))
        assert told(vector.quota_topk(few, *setting)) == told(vector.quota_topk(every, *setting))
    few = vector.best_scores(chunks, asked, [vector.Limit("score", 7)])
    assert told(vector.topk(few, 7)) == told(vector.topk(every, 7))
    assert few.count() <= 5 * 8 * 7
    assert vector.best_scores(chunks, asked.limit(0), [vector.Limit("score", 7)]).count() == 0
    assert vector.best_scores(chunks.limit(0), asked, [vector.Limit("score", 7)]).count() == 0


def test_few_rows_leave_the_scan(spark, sf_dir):
    from ragloom.sources import tables

    chunks, asked = tables.chunks(spark, sf_dir).coalesce(2), tables.queries(spark, sf_dir)
    pairs = vector.fused_scores(chunks, asked).count()
    assert vector.best_scores(chunks, asked, vector.quota_limits()).count() < pairs / 2


def test_few_documents_fill_no_pool_but_let_few_rows_through():
    """With fewer documents than a limit asks for, each chunk of theirs was kept and sorted anew."""
    import numpy as np

    r = np.random.default_rng(2)
    points, asked = r.normal(size=(4000, 8)), r.normal(size=(6, 8))
    limits = [vector.Limit("score", 50, "academic", 2)]
    group, taken = vector._Best(0, asked, -asked, limits), 0
    none, true = np.zeros(0, int), np.ones(100, bool)
    for k in range(0, 4000, 100):
        batch = {"chunk_id": np.arange(k, k + 100), "doc": np.arange(k, k + 100) % 3, "kind": np.zeros(100, int), "regular": true}
        before = group.new
        group.add(points[k : k + 100], np.sqrt((points[k : k + 100] ** 2).sum(1)), batch, [(slice(0, 100), [True])], (none, none))
        taken += group.new - before
        group.prune()
    score = np.maximum(points @ asked.T, points @ -asked.T)
    docs = np.arange(4000) % 3
    best = {(q, int(c)) for q in range(6) for d in range(3) for c in sorted(np.flatnonzero(docs == d), key=lambda c: -score[c, q])[:2]}
    rows = group.rows[0]
    assert set(zip(rows["query"].tolist(), rows["chunk_id"].tolist())) == best
    assert taken < 4000 * 6 / 10


def test_many_queries_are_dealt_in_blocks(spark, monkeypatch):
    """Tasks send no more rows than their queries' limits let through, however many queries there are."""
    monkeypatch.setattr(vector, "GROUP", 4)
    r = random.Random(5)
    rows = [(k, f"d{k % 5}", "academic" if k % 5 < 2 else "public", [r.gauss(0, 1) for _ in range(4)]) for k in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc string, doc_type string, vector array<float>").repartition(8)
    asked = spark.createDataFrame([(q, [r.gauss(0, 1) for _ in range(4)], [r.gauss(0, 1) for _ in range(4)], [q, q + 1]) for q in range(40)], "query_id long, original array<double>, translated array<double>, exclude array<long>")
    few = vector.best_scores(chunks, asked, [vector.Limit("score", 7)])
    columns = ("query_id", "chunk_id", "score", "score_original", "rank")
    assert _rows(vector.topk(few, 7), *columns) == _rows(vector.topk(vector.fused_scores(chunks, asked), 7), *columns)
    assert few.count() <= 40 * 7
