"""Robots files against the standard library's parser, schedules against a plain walk, encodings of known texts."""

import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from ragloom.operators import crawl

AGENT = "RagBot/1.0"


def made_file(rng):
    line = lambda: rng.choice(
        ["User-agent: *", "User-agent: ragbot", "user-AGENT: other", "User-agent: RagBot # us", "Disallow: /a", "Disallow:", "Allow: /a/b", "Disallow: /", "allow : /c?x=1", "Crawl-delay: 7", "Crawl-delay: x", "Sitemap: /s", "nonsense", "", "", "# note", "Disallow: /%7Eu", "Disallow: *"]
    )
    return "\n".join(line() for _ in range(rng.randrange(14)))


def test_rules_are_those_of_the_standard_parser(spark):
    rng = random.Random(2)
    paths = ["", "/", "/a", "/a/b/c", "/c?x=1&y", "/c", "/~u/x", "/%7Eu", "/b"]
    files = [(f"http://s{k}.x", made_file(rng)) for k in range(300)]
    urls = [(k * 100 + i, site + path) for k, (site, _) in enumerate(files) for i, path in enumerate(paths)]
    told = crawl.robots_allowed(spark.createDataFrame(urls, "id long, url string").withColumn("rules", F.lit(1)).drop("rules"), spark.createDataFrame([(s, 200, b) for s, b in files], "site string, status int, body string"), AGENT)
    found = {r.id: (r.allowed, r.delay) for r in told.collect()}
    for k, (site, body) in enumerate(files):
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        for i, path in enumerate(paths):
            assert found[k * 100 + i][0] == parser.can_fetch(AGENT, site + path), (body, path)
        assert found[k * 100][1] == parser.crawl_delay(AGENT), body


def test_the_status_decides_first_and_the_longest_rule_may(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nAllow: /x.pdf$\n"
    files = spark.createDataFrame([("http://a", 404, "User-agent: *\nDisallow: /"), ("http://b", 403, ""), ("http://c", None, None), ("http://d", 200, body)], "site string, status int, body string")
    urls = spark.createDataFrame([(u,) for u in ("http://a/x", "http://b/x", "http://c/x", "http://none/x", "http://d/a/b", "http://d/a/c", "http://d/f.pdf", "http://d/f.pdf?x", "http://d/x.pdf", None)], "url string")
    said = lambda longest: {r.url: r.allowed for r in crawl.robots_allowed(urls, files, AGENT, longest).collect()}
    first, best = said(False), said(True)
    assert [first[u] for u in ("http://a/x", "http://b/x", "http://c/x", "http://none/x", None)] == [True, False, False, False, False]
    assert not first["http://d/a/b"] and first["http://d/f.pdf"]
    assert [best[u] for u in ("http://d/a/b", "http://d/a/c", "http://d/f.pdf", "http://d/f.pdf?x", "http://d/x.pdf")] == [True, False, False, True, True]


@pytest.mark.parametrize("block", [5, 60, 10**6])
def test_no_two_requests_of_a_site_are_nearer_than_its_gap(spark, block):
    rng = random.Random(block)
    rows = [(k, rng.choice("aaab"), float(rng.randrange(400)), float(g)) for k, g in ((k, 3) for k in range(500))]
    found = {r.request_id: r.start for r in crawl.request_schedule(spark.createDataFrame(rows, "request_id long, site string, ready double, gap double").repartition(4), block).collect()}
    last = {}
    for k, site, ready, gap in sorted(rows, key=lambda r: (r[2], r[0])):
        last[site] = max(ready, last.get(site, -1e9) + gap)
        assert found[k] == last[site]
    assert crawl.request_schedule(spark.createDataFrame([], "request_id long, site string, ready double, gap double")).count() == 0


def test_encodings_are_guessed_and_read(spark):
    korean = "당뇨병 환자는 혈당을 자주 측정해야 합니다. Type 2 diabetes 관리."
    german = "Müller überprüft das Größte, naïve café señor"
    known = [(korean, "euc-kr", "cp949"), (korean, "utf-8", "utf-8"), (german, "latin-1", "latin-1"), ("Это предложение на русском языке.", "cp1251", "cp1251"), ("plain ascii", "ascii", "utf-8"), ("", "ascii", "utf-8")]
    for text, encoding, guess in known:
        data = text.encode(encoding)
        assert crawl.guess_encoding(data) == guess
        if len(data) > 20:  # cut off within a character
            assert crawl.guess_encoding(data[:-1]) == guess and crawl.guess_encoding(korean.encode()[:50]) == "utf-8"
    rows = [(k, bytearray(t.encode(e)), None) for k, (t, e, _) in enumerate(known)] + [(90, None, None), (91, bytearray(german.encode("latin-1")), "ISO-8859-1"), (92, bytearray(b"abc"), "no-such"), (93, bytearray(b"\xef\xbb\xbfx\xff"), None), (94, bytearray("ü".encode("utf-16")), None)]
    found = {r.key: (r.encoding, r.text) for r in crawl.decoded(spark.createDataFrame(rows, "key long, content binary, charset string")).collect()}
    assert [found[k] for k in range(len(known))] == [(g, t) for t, _, g in known]
    assert found[90] == (None, None) and found[91] == ("ISO-8859-1", german) and found[92] == ("utf-8", "abc") and found[93] == ("utf-8", "x�") and found[94] == ("utf-16-le", "ü")


def test_latin_texts_that_end_in_their_only_letter_or_are_short(spark):
    """Read as a cut-off UTF-8 or Korean character, or as single Cyrillic or Chinese ones, before."""
    texts = ["der den ist chenen\u00e4", "Rement\u00e7", "\u00d6r", "un \u00e9", "\u00e8\u00e9\u00e8 &&&", "\u00d6\u00df,", "Ci\u00f3n d", "l'\u00e9t\u00e9 \u00e0", "\u00c9\u00e9 \u00c9\u00e9 \u00c9\u00e9"]
    rows = [(k, bytearray(t.encode("latin-1")), None) for k, t in enumerate(texts)]
    found = {r.key: (r.encoding, r.text) for r in crawl.decoded(spark.createDataFrame(rows, "key long, content binary, charset string")).collect()}
    assert found == {k: ("latin-1", t) for k, t in enumerate(texts)}
    assert crawl.guess_encoding("abc\u4f60".encode()[:-1]) == "utf-8"
