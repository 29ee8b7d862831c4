"""Learned and added results of operators 2 to 9 against plain versions, and what hot keys and clashing names do."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ragloom.llm import fingerprint, language, licenses, mixing, quality, secrets, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- operator 2


def test_large_rates_are_drawn(spark):
    ids = spark.range(400).selectExpr("id as doc_id", "'a' as source")
    for rate in (700.0, 4321.0):
        drawn = [r.n for r in ids.select(mixing.copies({"a": rate}, 1.0, "s").alias("n")).collect()]
        mean = sum(drawn) / len(drawn)
        assert abs(mean - rate) < 5 * math.sqrt(rate / len(drawn))
        assert 0.6 * rate < sum((x - mean) ** 2 for x in drawn) / len(drawn) < 1.5 * rate
    scarce = spark.createDataFrame([(k, "b", "t", 100) for k in range(2000)] + [(5000, "a", "t", 100), (5001, None, "t", None), (5001, None, "t", None)], "doc_id long, source string, text string, n_chars long")
    got = Counter(r.source for r in mixing.mix(scarce, {"a": 0.9}).select("source").collect())
    assert got["a"] > 1500 and got["b"] < 400


# ---- operator 3


def plain_features(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars, n = sum(map(len, words)), max(1, len(words))
    count = lambda kept: len(re.findall(f"[{kept}]", text or ""))
    features = {
        "q_words": float(len(words)),
        "q_word_length": chars / n,
        "q_symbols": count("#*$%&|<>") / n,
        "q_bangs": count("!") / n,
        "q_capitals": count("A-Z") / max(1, chars),
        "q_same_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "q_repeats": len(again) / n,
    }
    return features, len(words) < 50 or 100 * len(again) > 50 * len(words)


def test_quality_verdicts_match_a_plain_list(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = quality.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert rules
    got = {r.doc_id: r.kept for r in quality.op3_quality_rules(spark, sf_dir).collect()}
    for r in documents.collect():
        features, failed = plain_features(r.text)
        rejected = any(all(test.holds(features) for test in rule) for rule in rules)
        assert got[r.doc_id] == (not failed and not rejected), r.doc_id


def test_a_filter_on_the_verdict_computes_nothing_twice(spark, sf_dir, documents):
    rules = [[quality.Test("q_symbols", True, 0.3)]]
    plain = quality.apply_rules(documents, rules)
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(")
    assert count(plain.filter("not q_base_failed").select("doc_id", "q_kept")) <= count(plain)
    assert plain.filter("not q_base_failed").count() > 10


# ---- operator 4


def as_pattern(template):
    """A template as a pattern over words that each follow a blank."""
    out = ""
    for token in re.findall(r"<<|>>|\[\[\d+\]\]|\{[^}]*\}|[^\s<>{}\[\]]+", template):
        if token == "<<":
            out += "(?:"
        elif token == ">>":
            out += ")?"
        elif token.startswith("[["):
            out += f"(?: [^ ]+){{0,{token[2:-2]}}}"
        else:
            out += " (?:" + "|".join(map(re.escape, token.strip("{}").split("|"))) + ")"
    return re.compile(out + "(?= |$)")


def plain_labels(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    line = " " + " ".join(words)
    labels = {label for phrase, label in licenses.BASE if f" {phrase} " in line + " "}
    return ",".join(sorted(labels | {label for label, _, template in licenses.TEMPLATES if as_pattern(template).search(line)}))


def made_from(template, r):
    """A text that a template matches."""
    text = re.sub(r"\{([^}]*)\}", lambda m: r.choice(m[1].split("|")), template)
    text = re.sub(r"\[\[(\d+)\]\]", lambda m: " ".join(["Name"] * r.randint(0, int(m[1]))), text)
    while "<<" in text:
        text = re.sub(r"<<([^<>]*)>>", lambda m: m[1] if r.random() < 0.5 else "", text)
    return text


def test_licence_labels_match_patterns(spark, documents):
    r, rows = random.Random(4), []
    for _, _, template in licenses.TEMPLATES:
        for _ in range(6):
            words = made_from(template, r).upper().split()
            rows.append(f"It is {', '.join(words)}. End")
            words[r.randrange(len(words))] = "other"
            rows.append(f"It is {' '.join(words)} end")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").unionByName(documents.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = {x.doc_id: x.labels for x in licenses.scan(docs).collect()}
    for x in docs.collect():
        assert got[x.doc_id] == plain_labels(x.text), x.text[:300]
    assert len({label for k in range(len(rows)) for label in got[k].split(",")}) >= len(licenses.TEMPLATES) - 1


def test_templates_of_ones_own_are_found(spark):
    docs = spark.createDataFrame([(1, "The Quick  brown-fox"), (2, "quick red fox")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(docs, [("own", 0.5, "quick <<very>> brown")]).collect()}
    assert got == {1: "own", 2: ""}


# ---- operator 5


def plain_grams(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        word = "".join(c for c in word if c.isalpha())
        padded = f" {word} "
        out.update(word)
        out.update(padded[k : k + 2] for k in range(len(padded) - 1))
        out.update(padded[k : k + 3] for k in range(len(padded) - 2))
    return out


def order_of(grams):
    code = lambda g: sum((0x110000 if c == " " else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(grams, key=lambda g: (-grams[g], code(g)))[: language.PROFILE]


def test_languages_match_a_plain_version(spark, sf_dir, documents):
    import zlib

    rows = documents.collect()
    learned = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            learned.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {lang: order_of(c) for lang, c in sorted(learned.items())}
    ranks = {lang: {g: k for k, g in enumerate(p)} for lang, p in profiles.items()}
    got = {r.doc_id: r for r in language.op5_language_id(spark, sf_dir).collect()}
    for r in rows:
        mine = order_of(plain_grams(r.text))
        if not mine:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(known[g] - k) if g in known else language.PROFILE for k, g in enumerate(mine)) for lang, known in ranks.items()}
        best = min(sorted(far), key=far.get)
        assert got[r.doc_id].lang_pred == best, (r.doc_id, far)
        assert got[r.doc_id].score == pytest.approx(1 - far[best] / (language.PROFILE * len(mine)))


def test_many_languages(spark):
    rows = [(k, "".join(chr(0x4E00 + 5 * k + j) for j in (0, 1, 2, 1)) * 3, f"l{k:04d}") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.profiles(docs)
    assert len(learned) > 500
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, learned).collect()}
    assert all(got[k] == lang for k, _, lang in rows if lang in learned)


# ---- operator 6


def test_slots_of_equal_rows(spark):
    rows = spark.createDataFrame([(None, "hot")] * 300 + [(k, "t") for k in range(20)], "doc_id long, text string").repartition(5)
    docs, _ = sharding.assign(rows, 3)
    got = sharding.numbered(docs.select("doc_id", "s_hash", "s_shard"), 4).collect()
    assert len(got) == 320
    for shard in {r.s_shard for r in got}:
        assert sorted(r.slot for r in got if r.s_shard == shard) == list(range(sum(r.s_shard == shard for r in got)))


# ---- operator 7


def normal(z):
    z = max(-20.0, min(20.0, z))
    return 1 / (1 + math.exp(-z * (1.5976 + 0.07056 * z * z)))


def plain_secrets(text):
    """kind:start:end of all spans, by the battery written out for one token at a time."""
    base = []
    for rank, (kind, pattern, group, least, _) in enumerate(secrets.BASE):
        base += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    found, n_maybe = [], 0
    for m in re.finditer(secrets.CANDIDATE, text):
        token = m[0]
        if sum(bool(re.search(k, token)) for k in ("[0-9]", "[a-z]", "[A-Z]")) < 2 or any(s < m.end() and m.start() < e for s, _, e, _ in base):
            continue
        n_maybe += 1
        name, _, alphabet, agree = next((e for e in secrets.ENCODINGS[:-1] if re.search(e[1], token)), secrets.ENCODINGS[-1])
        low = token.lower() if name in ("hex", "base36") else token.replace("_", "/").replace("-", "+")
        v, n, k = [alphabet.index(c) for c in low], len(low), len(alphabet)
        chi = k / n * sum(c * c for c in Counter(low).values()) - n
        middle = (k - 1) / 2
        runs = 1 + sum((a > middle) != (b > middle) for a, b in zip(v, v[1:]))
        serial = sum((a - middle) * (b - middle) for a, b in zip(v, v[1:]))
        zs = [(runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4), serial / ((k * k - 1) / 12 * math.sqrt(n - 1))]
        if 1 - normal((chi - k + 1) / math.sqrt(2 * (k - 1))) < secrets.NOT_RANDOM or any(2 * normal(-abs(z)) < secrets.NOT_RANDOM for z in zs):
            continue
        changes = sum(a.isdigit() != b.isdigit() and a.isalnum() and b.isalnum() or a.islower() and b.isupper() for a, b in zip(token, token[1:]))
        kinds = (changes - (n - 1) * secrets.CHANGES) / math.sqrt((n - 1) * secrets.CHANGES * (1 - secrets.CHANGES))
        excess = n * (k * agree - 1)
        p = normal(((chi - k + 1 - excess) / math.sqrt(2 * (k - 1) + 4 * excess) - kinds) / math.sqrt(2))
        found.append((m.start(), len(secrets.BASE), m.end(), "random", p, n))
    mean = sum(f[5] for f in found) / max(1, len(found))
    weighted = sorted(f[4] * mean / f[5] for f in found)
    limit = max((p for k, p in enumerate(weighted, 1) if p <= secrets.RATE * k / n_maybe), default=-1)
    spans = sorted(base + [f[:4] for f in found if f[4] * mean / f[5] <= limit])
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


ALPHABETS = {"HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base62": secrets.ENCODINGS[3][2], "base64": secrets.ENCODINGS[4][2]}


def test_spans_match_a_plain_battery(spark, documents):
    r, rows = random.Random(12), []
    for k in range(300):
        parts = []
        for _ in range(r.randint(1, 6)):
            kind = r.choice((*ALPHABETS, "words", "base"))
            if kind == "words":
                parts.append("-".join(r.sample("annual report of the public health guide draft final version two".split(), 4)) + str(r.randrange(3000)))
            elif kind == "base":
                parts.append("password=" + "".join(r.choice("abc123") for _ in range(r.randint(3, 30))))
            else:
                parts.append("".join(r.choice(ALPHABETS[kind]) for _ in range(r.randint(18, 60))))
        rows.append((10**6 + k, r.choice((" ", "\n", "; é ")).join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    got = {x.doc_id: x.s for x in secrets.scan(docs).select("x_row.doc_id", secrets.described(F.col("x_spans")).alias("s")).collect()}
    for x in docs.collect():
        assert got[x.doc_id] == plain_secrets(x.text or ""), x.text


#: Share of random tokens that must be found, by encoding, at 20, 24 and 32 characters.
LEAST_FOUND = {"HEX": (0.85, 0.9, 0.9), "base32": (0.6, 0.7, 0.8), "base36": (0.8, 0.85, 0.9), "base62": (0.9, 0.9, 0.95), "base64": (0.85, 0.9, 0.95)}


def test_found_share_by_encoding_and_length(spark):
    r, rows = random.Random(4), []
    for name, alphabet in ALPHABETS.items():
        for k, n in enumerate((20, 24, 32)):
            rows += [(name, k, "see " + "".join(r.choice(alphabet) for _ in range(n)) + " here") for _ in range(200)]
    words = "release notes annual report spring committee summary appendix figure chapter section update".split()
    rows += [("words", 0, "see " + r.choice("-_/").join(r.sample(words, 4)).title() + str(r.randrange(2100))) for _ in range(400)]
    found = secrets.scan(spark.createDataFrame(rows, "name string, k int, text string").repartition(8)).groupBy("x_row.name", "x_row.k").agg(F.avg((F.size("x_spans") > 0).cast("int")).alias("share"))
    for x in found.collect():
        if x.name == "words":
            assert x.share <= 0.01
        else:
            assert x.share >= LEAST_FOUND[x.name][x.k], (x.name, x.k, x.share)


def test_texts_full_of_tokens_take_time_in_proportion(spark):
    import time

    r, took = random.Random(1), []
    for n in (400, 1600):
        text = " ".join("".join(r.choice(ALPHABETS["base62"]) for _ in range(24)) + " password=abcdef1" for _ in range(n))
        began = time.time()
        clean = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
        took.append(time.time() - began)
        assert clean.count("[SECRET]") > 1.8 * n and "abcdef1" not in clean
    assert took[1] < 8 * took[0] + 3


# ---- operator 9


def test_rows_of_one_id_are_ordered_over_ranges(spark):
    r = random.Random(3)
    rows = [(None if k % 3 else k, " ".join(r.choice("abcdefgh") * 3 for _ in range(12)) + f" {k}") for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    order = sorted(rows, key=lambda x: (-(1 << 63) if x[0] is None else x[0], signed(x[1])))
    want = Counter()
    for k, (doc_id, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = fingerprint.fingerprint_next(docs).collect()
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in got) == want
    ranges = fingerprint.in_ranges(docs, 32).filter("f_tail = 0").groupBy("f_range").count().collect()
    assert len(ranges) > 16 and max(x["count"] for x in ranges) < 40
    finer = fingerprint.MOST_STARTS
    try:
        fingerprint.MOST_STARTS = 8
        assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in fingerprint.fingerprint_next(docs).collect()) == want
    finally:
        fingerprint.MOST_STARTS = finer


# ---- clashing names


def test_stages_keep_columns_of_any_name(spark, sf_dir, edge):
    names = ["q_text", "q_n_words", "q_kept", "x_text", "x_low", "x_row", "filter_task", "n_id", "copy_no", "shuffle_key", "node", "bad name"]
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in out.collect())
    kept = quality.apply_rules(docs, [])
    assert kept.select("q_n_words").first() is not None and "x_text" in kept.columns
