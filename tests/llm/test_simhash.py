"""Operator 10 against a plain version over all pairs."""

import re

import xxhash

from ragloom.llm import simhash
from ragloom.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    """doc_id to (fingerprint, least doc_id reachable) over all pairs."""
    prints = {d: plain_print(t) for d, t in rows}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_whole_table_matches_plain_version(spark, sf_dir, documents):
    want = plain_components([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, sf_dir).collect()}
    assert got == want


def test_edge_rows(edge):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").distinct().collect() if r.doc_id is not None]
    want = plain_components(rows)
    got = simhash.near_components(edge).collect()
    assert len(got) == edge.count()
    for r in got:
        if r.doc_id is not None:
            assert (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) == want[r.doc_id]


def test_links_reach_two_bits_and_no_further(spark):
    base = 0x0F0F0F0F0F0F0F0F
    prints = [base, base ^ 3, base ^ 0b111 << 20, base ^ 1 << 63, base ^ (1 << 63 | 1 << 62 | 1 << 61)]
    rows = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = components(simhash.links(rows)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, {r.root}).add(r.node)
    want = {simhash._signed(p) for k, p in enumerate(prints) if k != 2}
    assert list(groups.values()) == [want]


def test_chunks_of_a_long_text_don_t_show(monkeypatch):
    text = "a b c d e f g " * 50
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.simhash(text) == whole == plain_print(text)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 501), (7, 6)], "u long, v long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{k: 0 for k in range(1, 201)}, 501: 500}


def test_empty(empty):
    assert simhash.near_components(empty).collect() == []
