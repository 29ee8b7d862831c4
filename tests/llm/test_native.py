"""Operators 2, 3, 6, 7 and 9 against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from ragloom.llm import fingerprint, mixing, quality, secrets, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- operator 2


def rows_of(df):
    return sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))


def test_mixing_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    got = mixing.op2_poisson_mixing(spark, sf_dir)
    cur = con.execute(mixing.OP2_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(str(sorted(zip(names, r))) for r in cur.fetchall())
    assert rows_of(got) == want


def test_poisson_steps_invert_the_distribution():
    for rate in (0.0, 0.3, 1.0, 7.5, 80.0):
        steps = mixing.poisson_steps(rate)
        assert steps == sorted(steps) and abs(steps[-1] - 1) < 1e-9
        grid = [(k + 0.5) / 20000 for k in range(20000)]
        mean = sum(sum(u >= s for s in steps) for u in grid[::20]) / 1000
        assert abs(mean - rate) < 0.05 * max(1, rate)
    with pytest.raises(ValueError):
        mixing.poisson_steps(-1)


def test_mixing_reaches_weights(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) as source", "10L as n_chars")
    got = Counter(r.source for r in mixing.mix(docs, {"a": 0.6, "b": 0.1}).collect())
    n = sum(got.values())
    assert abs(got["a"] / n - 0.6) < 0.04 and abs(got["b"] / n - 0.1) < 0.03 and abs(got[None] / n - 0.3) < 0.04


def test_copies_in_blocks_are_the_same_copies(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "rare", 1), (2, "b", 900), (3, "b", 700), (3, "b", 700), (None, "c", 400)], "doc_id long, source string, n_chars long").withColumn("mix_block", F.lit("x"))
    at_once = rows_of(mixing.mix(docs, {"rare": 0.3}))
    monkeypatch.setattr(mixing, "COPY_BLOCK", 7)
    assert rows_of(mixing.mix(docs, {"rare": 0.3})) == at_once and len(at_once) > 500


def test_slots_in_blocks_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_BLOCK", 10)
    rows = spark.range(1000).selectExpr("id % 3 AS doc_id", "id % 3 AS s_hash", "CAST(id % 2 AS INT) AS s_shard")
    found = sharding.numbered(rows).groupBy("s_shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    assert {tuple(r)[1:] for r in found} == {(500, 500, 0, 499)}


def test_mixing_edges(edge, empty):
    assert mixing.mix(empty, mixing.TARGET_WEIGHTS).collect() == []
    assert set(mixing.mix(edge, {"src0": 0.5}).columns) == {*edge.columns, "copy_no", "shuffle_key"}
    with pytest.raises(ValueError):
        mixing.mix(edge.withColumnRenamed("h", "copy_no"), {})
    with pytest.raises(ValueError):
        mixing.rates(edge, {"a": 0.9, "b": 0.2})


# ---- operator 3


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark, sf_dir, documents, edge):
    got = {r.doc_id: r for r in quality.op3_quality_rules(spark, sf_dir).collect()}
    kept = 0
    for r in documents.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == plain_counts(r.text)
        assert not (g.base_failed and g.kept)
        kept += g.kept
    assert 0 < kept < len(got)
    for r in quality.apply_rules(edge, []).collect():
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed) == plain_counts(r.text)


def test_quality_verdict_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rules = quality.fit(docs, labels)
    assert rules
    rows = quality.apply_rules(docs.select("doc_id", "text"), rules).join(labels, "doc_id").filter("not q_base_failed").collect()
    assert sum(r.q_kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    assert sum(not r.q_kept for r in rows if r.quality == 1) <= 0.01 * len(rows)


def test_learned_list_finds_thresholds_and_keeps_clean_rows():
    base = dict.fromkeys(quality.FEATURES, 0.0)
    rows = [{**base, "q_words": float(k), "q_symbols": (k % 7) / 10, "bad": int(k % 7 >= 5)} for k in range(700)]
    rules = quality.learn(rows)
    fires = lambda r: any(all(t.holds(r) for t in rule) for rule in rules)
    assert all(fires(r) == bool(r["bad"]) for r in rows)
    assert quality.learn([{**base, "bad": 0}] * 50) == [] == quality.learn([])


def test_the_sample_is_bounded_by_ids(spark, monkeypatch):
    """Rows of one id, in either table, are one row of what the driver learns from."""
    docs = spark.range(40_000).selectExpr("id % 50 AS doc_id", "concat('word ', id % 7, ' some more words of a text') AS text", "1 AS q_row")
    labels = spark.range(2000).selectExpr("id % 50 AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    seen = []
    monkeypatch.setattr(quality, "learn", lambda rows: seen.extend(rows) or [])
    assert quality.fit(docs, labels) == []
    assert 0 < len(seen) <= 50


def test_quality_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(empty, labels) == []
    assert quality.apply_rules(empty, []).collect() == []


# ---- operator 6


def plain_capacity(sizes, shards):
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


def check_shards(rows, got, shards=24):
    groups = Counter()
    for _, text in rows:
        groups[signed_hash(text)] += len((text or "").encode()) + 8
    sums, slots, of_text = Counter(), {}, {}
    for doc_id, text, size, shard, slot in got:
        assert size == len((text or "").encode()) + 8 and 0 <= shard < shards
        sums[shard] += size
        slots.setdefault(shard, []).append(slot)
        assert of_text.setdefault(text, shard) == shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ordered = [groups[h] for h in sorted(groups)]
    assert max(sums.values()) <= plain_capacity(ordered, shards)


def test_shards_are_minimal(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = sharding.op6_minimax_shards(spark, sf_dir).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    check_shards(list(texts.items()), [(r.doc_id, texts[r.doc_id], r.size, r.shard, r.slot) for r in got])


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_cut_points_equal_plain_search(spark, shards):
    sizes = [(((k * 2654435761) % (1 << 64)) - (1 << 63), 1 + (k * 7919) % 1000 + (50000 if k == 33 else 0)) for k in range(900)]
    groups = spark.createDataFrame(sizes, "h long, bytes long").cache()
    capacity, last = sharding.cut_points(groups, shards, first_bits=3, split_bits=3)
    ordered = [b for _, b in sorted(sizes)]
    assert capacity == plain_capacity(ordered, shards)
    held = Counter(sum(h > x for x in last) for h, _ in sizes for _ in [0])
    sums = Counter()
    for h, b in sizes:
        sums[sum(h > x for x in last)] += b
    assert max(sums.values()) == capacity or shards == 40 and max(sums.values()) <= capacity
    assert len(held) <= shards


def test_shard_edges(edge, empty):
    docs, _ = sharding.assign(edge)
    rows = sharding.numbered(docs).collect()
    assert len(rows) == edge.count()
    check_shards([(r.doc_id, r.text) for r in rows], [(r.doc_id, r.text, r.s_bytes, r.s_shard, r.slot) for r in rows])
    docs, capacity = sharding.assign(empty)
    assert capacity == 0 and sharding.numbered(docs).collect() == []


# ---- operator 7

ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def check_secrets(text, row):
    base = plain_base(text)
    said = [f"{kind}:{start}:{end}" for start, _, end, kind in base]
    counts = Counter(s[3] for s in base)
    assert (row.n_assign, row.n_access, row.n_hex) == (counts["assign"], counts["access"], counts["hex"])
    assert row.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
    assert [s for s in row.spans.split(",") if s and not s.startswith("random")] == said


def test_secrets_base(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in secrets.op7_secret_scan(spark, sf_dir).collect():
        check_secrets(texts[r.doc_id], r)


def test_secrets_edges(spark, edge, empty, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in edge.collect()}
    got = secrets.op7_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == edge.count()
    for r in got:
        check_secrets(texts[r.doc_id], r)
    eight = next(r for r in got if r.doc_id == 8)
    assert (eight.n_assign, eight.n_access, eight.n_hex) == (1, 1, 1)
    assert next(r for r in got if r.doc_id == 12).spans.startswith("random:0:32")
    assert secrets.scan(empty).collect() == []


def test_random_tokens_and_words(spark):
    r = __import__("random").Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(60)]
    words = ["internationalization2and1localization", "zzzzzzzzzzzzzzzzzzzzzzzz1", "the/path/to/some/file/number/12/in/the/tree", "xyxyxyxyxyxyxyxyxyxyxyxy12", "version1version2version3version4"]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate(keys + words)], "doc_id long, text string")
    found = {r.x_row.doc_id for r in secrets.scan(docs).filter("size(x_spans) > 0").collect()}
    assert len([k for k in found if k < 60]) >= 54 and not [k for k in found if k >= 60]


def test_redaction(edge):
    clean = {r.doc_id: r.text for r in secrets.redact(edge).collect()}
    assert clean[1] is None and clean[4] == "One"
    assert clean[8] == "password: abc token:token = abcdefgh [SECRET]\" [SECRET] AKIA12 é [SECRET]"


# ---- operator 9


def plain_signature(text):
    counts = Counter(WORD.findall((text or "").lower()))
    if not counts:
        return None
    u64 = lambda x: x & (1 << 64) - 1
    out = []
    for k in range(fingerprint.SAMPLES):
        best = None
        for word, n in counts.items():
            t0 = xxhash.xxh64_intdigest(word.encode(), 42)
            # two values are hashed one after the other, each with the last hash as seed
            h = xxhash.xxh64_intdigest((k).to_bytes(4, "little"), xxhash.xxh64_intdigest(t0.to_bytes(8, "little"), 42))
            g = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
            u = lambda x, at, bits: ((x >> at & (1 << bits) - 1) + 0.5) / (1 << bits)
            r = -math.log(u(h, 0, 21) * u(h, 21, 21))
            ln_c = math.log(-math.log(u(g, 0, 32) * u(g, 32, 32)))
            b = u(h, 42, 21)
            t = math.floor(math.log(n) / r + b)
            a = math.floor((ln_c - r * (t - b + 1)) * fingerprint.SCALE)
            value = u64(g ^ u64(t * fingerprint.SPREAD)) & 0xFFFFFF
            best = min(best or (a, value), (a, value))
        out.append(best[1])
    return out


def plain_next(rows):
    rows = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        yield doc_id, text, text[: len(text) - q] + after[:q], after


def test_fingerprints(spark, sf_dir, documents):
    got = {r.doc_id: r for r in fingerprint.op9_weighted_fingerprints(spark, sf_dir).collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert len(got) == len(rows)
    for k, (doc_id, text, edited, after) in enumerate(plain_next(rows)):
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if k % 20 == 0:
            own, new, other = map(plain_signature, (text, edited, after))
            hexed = lambda s: "".join(f"{v:06x}" for v in s or [])
            assert (r.fingerprint, r.edited_fingerprint) == (hexed(own), hexed(new))
            assert r.near_edited == sum(a == b for a, b in zip(own, new)) / 32
            assert r.near_next == sum(a == b for a, b in zip(own, other)) / 32


def test_fingerprint_edges(edge, empty, spark):
    rows = fingerprint.fingerprint_next(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    for doc_id, text, edited, _ in plain_next([(r.doc_id, r.text) for r in edge.collect()]):
        if doc_id not in (6,):  # the repeated row has two next documents
            assert by[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "" and by[1].near_next == 1.0
    assert by[6].fingerprint == by[7].fingerprint
    assert fingerprint.fingerprint_next(empty).collect() == []
    one = fingerprint.fingerprint_next(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).collect()
    assert [(r.near_edited, r.near_next) for r in one] and one[0].near_next == 1.0


def test_collisions_estimate_generalised_jaccard(spark, monkeypatch):
    a = Counter({f"w{k}": 1 + k % 4 for k in range(40)})
    b = Counter({f"w{k}": 1 + (k + k // 20) % 4 for k in range(10, 55)})
    want = sum(min(a[w], b[w]) for w in a | b) / sum(max(a[w], b[w]) for w in a | b)
    near = []
    for seed in range(30):
        texts = [" ".join(f"{w}x{seed}" for w in c.elements()) for c in (a, b)]
        x, y = map(plain_signature, texts)
        near.append(sum(p == q for p, q in zip(x, y)) / len(x))
    assert abs(sum(near) / len(near) - want) < 0.05
