"""Operators of the reference on small cases: edges that the driver's tables don't have."""

import pytest
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import answers, catalog, chunking, dedup, markup, models, repro, retrieval, textclean, vector
from ragloom.sources import readers, sinks
from ragloom.streaming import catalog as streams


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def got(spark, value, how, kind="string"):
    return one(spark, value, kind).select(how(F.col("x")).alias("y")).first().y


def test_white_space_is_unicode(spark):
    assert got(spark, "a b　c d", T.count_chars) == 4
    assert got(spark, "  a b　\n", T.strip) == "a b"
    assert got(spark, "\t» a b\x07\n›c", T.normalise) == "- a b\n- c"


def test_language_share(spark):
    assert got(spark, "가나다abcdefg", T.language_of) == "ko"
    assert got(spark, "가나abcdefg", T.language_of) == "en"
    assert got(spark, "12 !", T.language_of) == ""


def test_page_ranges(spark):
    cases = {"1~8": list(range(1, 9)), "2-4": [2, 3, 4], "0:1": [0, 1], "1월 3일": [1, 2, 3], " 5 ": [5], "": [None], "x": None}
    for spec, want in cases.items():
        assert got(spark, spec, catalog.page_range) == want


def test_urls_need_a_page(spark):
    rows = spark.createDataFrame([("u/{page}", "0~2"), ("u/{page}", ""), ("v", "")], "url string, page_range string")
    assert sorted(r.url for r in catalog.expand_urls(rows).collect()) == ["u/1", "u/2", "v"]


def test_file_types(spark):
    rows = [(b"%PDF-1", "a", "pdf"), (b"\xff\xd8\xff\xe0", "a", "image"), (b"GIF89a", "a", "image"), (b"\xd0\xcf\x11\xe0", "a", "hwp"), (b"PK\x03\x04", "a.HWPX", "hwpx"), (b"PK\x03\x04", "a.zip", "unknown"), (b" \n<html>", "a", "html"), (b" \t\n" * 300 + b"<p>", "a", "html"), (b"x <p>", "a", "unknown"), (b"", "a", "unknown")]
    df = spark.createDataFrame([(bytearray(d), n, w) for d, n, w in rows], "d binary, n string, w string")
    assert all(r.t == r.w for r in df.select("w", catalog.detect_type(F.col("d"), F.col("n")).alias("t")).collect())


def test_registry_leaves_out_disabled(spark):
    rows = spark.createDataFrame([("a",), ("#b",), ("",), (None,), ("c",)], "source_id string")
    assert [r.source_id for r in catalog.active_sources(rows, ["a", "b"]).collect()] == ["a"]


def test_exclusion_is_not_transitive(spark):
    live = spark.createDataFrame([(k,) for k in range(1, 6)], "doc_id long")
    pairs = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.99), (3, 4, 0.99), (1, 5, 0.9)], "a long, b long, jaccard double")
    assert {r.doc_id: r.excluded_by for r in dedup.content_exclusion(live, pairs).collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None}


def test_exclusion_decides_long_chains(spark):
    """Each revision is the same as the one before only, so that a round decides one of them."""
    n = 54
    live = spark.createDataFrame([(k,) for k in range(n)], "doc_id long")
    pairs = spark.createDataFrame([(k, k + 1, 0.99) for k in range(n - 1)], "a long, b long, jaccard double").coalesce(1)
    assert {r.doc_id: r.excluded_by for r in dedup.content_exclusion(live.coalesce(1), pairs).collect()} == {k: k - 1 if k % 2 else None for k in range(n)}


def test_short_texts_have_no_shingles_and_languages_don_t_mix(spark):
    docs = spark.createDataFrame([(1, "en", "short"), (2, "en", "the same long text here"), (3, "de", "the same long text here"), (4, "en", "the same long text here."), (5, "en", None)], "doc_id long, lang string, text string")
    assert [(r.a, r.b) for r in dedup.jaccard_pairs(docs).collect()] == [(2, 4)]


def test_paragraphs(spark):
    cases = [
        (["운동은 혈액 순환을 도와주고 심장과 혈", "관계 건강에 좋다"], ["운동은 혈액 순환을 도와주고 심장과 혈관계 건강에 좋다"]),
        (["표 칸", "다음 칸"], ["표 칸 다음 칸"]),
        (["one", "two.", "three", "", "four"], ["one two.", "three", "four"]),
        (["1. Title", "text", "- item", "more"], ["1. Title", "text", "- item more"]),
        (["", " "], []),
        ([], []),
    ]
    for lines, want in cases:
        df = spark.createDataFrame([(lines,)], "l array<string>")
        assert textclean.with_paragraphs(df, "l").first().paragraphs == want


def test_edges_and_offsets(spark):
    pages = spark.createDataFrame([("d", k, f"Header\nbody {k}\nmore {k}\nx{k}\ny{k}\nz{k}\n{k + 4}") for k in range(1, 5)] + [("e", 1, "7")], "doc string, page long, text string")
    assert [(r.doc, r.line, r.n) for r in textclean.repeated_edges(pages).collect()] == [("d", "Header", 4)]
    assert {r.doc: r.page_offset for r in textclean.page_offset(pages).collect()} == {"d": 4, "e": 6}


def test_sections_of_texts_with_and_without_titles(spark):
    docs = spark.createDataFrame([(1, "plain\ntext"), (2, "# t\nintro\n## A\na\n### deep\nb\n## Funding\nc")], "doc_id long, text string")
    found = {(r.doc_id, r.title): r.body for r in textclean.sections(docs, "funding").collect()}
    assert found == {(2, "A"): "a\n### deep\nb"}


def test_windows(spark):
    cut = lambda t: got(spark, t, lambda c: chunking.windows(c, 500))
    assert cut("a" * 500) == ["a" * 500]
    assert [len(p) for p in cut("a" * 1000)] == [500, 500, 200]
    text = "x" * 300 + ". " + "y" * 400
    assert cut(text)[0] == "x" * 300 + "."
    text = "x" * 100 + ". " + "y" * 250 + " " + "z" * 400
    assert len(cut(text)[0]) == 352
    assert "".join(cut("w " * 2000)).count("w") >= 2000


def test_packing_starts_at_headings(spark):
    paras = ["1. Short", "a" * 100, "2. Next", "b" * 200, "3. Third", "c" * 800, "d" * 200, "44) note"]
    docs = spark.createDataFrame([(1, paras)], "doc_id long, paragraphs array<string>")
    rows = sorted(chunking.section_groups(docs).collect(), key=lambda r: r.group_no)
    assert [(r.section, r.body.split("\n")[0][:8]) for r in rows] == [("2. Next", "1. Short"), ("3. Third", "3. Third"), ("3. Third", "d" * 8)]


def test_quotas_are_targets(spark):
    rows = [(1, k, f"d{k % 3}", "public" if k == 9 else "academic", k / 10, k / 10) for k in range(10)]
    scored = spark.createDataFrame(rows, "query_id long, chunk_id long, doc string, doc_type string, score_original double, score double")
    picked = lambda **kw: [r.chunk_id for r in vector.quota_topk(scored, **kw).orderBy("rank").collect()]
    assert picked(k=4, per_doc=1, public=3) == [9, 8, 7]
    assert picked(k=20, per_doc=None, public=0) == list(range(9, -1, -1))
    assert picked(k=3, per_doc=2, academic=2, public=1) == [9, 8, 7]
    ties = scored.withColumn("score", F.lit(1.0)).withColumn("score_original", F.lit(1.0))
    assert [r.chunk_id for r in vector.topk(ties, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert got(spark, [0.0, 0.0], vector.l2_normalise, "array<double>") == [0.0, 0.0]


def test_gold_specs(spark):
    cases = {"a:105-106,110; b:49; c": {"a": [105, 106, 110], "b": [49], "c": []}, "": {}, "a:1; a:3": {"a": [1, 3]}, "a; a:3": {"a": [3]}, "a:x": {"a": []}}
    for spec, want in cases.items():
        rows = retrieval.gold(spark.createDataFrame([(1, spec)], "query_id long, spec string")).collect()
        assert {r.doc: r.pages for r in rows} == want


SCOPES = [
    ("diabetes", "maybe", [], ("in", [])),
    ("diabetes", "partial", ["obesity", "old age", "x"], ("partial", ["x"])),
    ("diabetes", "out", ["x"], ("partial", ["x"])),
    ("diabetes", "out", [], ("in", [])),
    ("my knee", "partial", ["x"], ("out", ["x"])),
    ("diabetes", "partial", [], ("in", [])),
    ("fracture and arthritis", "in", [], ("partial", ["arthritis", "fracture"])),
]


@pytest.mark.parametrize("question, scope, items, want", SCOPES)
def test_scope_rules(spark, question, scope, items, want):
    df = spark.createDataFrame([(question, scope, items)], "q string, s string, o array<string>")
    r = df.select(answers.scope_rules(F.col("q"), F.col("s"), F.col("o"), "diabet|obes", "old age", "arthritis|fracture").alias("r")).first().r
    assert (r.scope, r.out_of_scope) == want


def test_sentences_are_dropped_but_references_stay(spark):
    text = "Keep. Drop bad one. Keep too.\nbad.\n\nlast\nReferences:\nbad source."
    assert got(spark, text, lambda c: answers.drop_sentences(c, "bad", "References:")) == "Keep. Keep too.\n\nlast\nReferences:\nbad source."
    assert got(spark, "fine\nReferences:\nbad", lambda c: answers.banned(c, "bad", "References:")) is False
    assert got(spark, "a\n- - b", answers.single_bullets) == "a\n- b"


def test_citations(spark):
    assert got(spark, "x [2][1] and [2] [a]", answers.cited) == [1, 2]
    sources = got(spark, "[1] t (doc-1) p (0.53)\n[2] nothing\n[3] t (d2) q [OCR] (0.4)", answers.source_docs)
    assert [(s.rank, s.doc) for s in sources] == [(1, "doc-1"), (3, "d2")]


def test_links_and_titles(spark):
    page = "<title>t &amp; u</title><h1> <b>Head</b></h1><a href='x'>no</a><a class=q href=\"/a.pdf\">One <i>two</i></a><a href=\"#x\">x</a><a href=\"b.pdf\">b</a><a href=\"//h/c.PDF\">c</a><a href=\"/a.pdf\">again</a><a href=\"mailto:a.pdf\">m</a>"
    df = spark.createDataFrame([(1, "https://s.example/p/q.html?z=1", page)], "page_id long, url string, html string")
    rows = sorted((r.url, r.label) for r in markup.links(df, "\\.pdf").collect())
    assert rows == [("https://h/c.PDF", "c"), ("https://s.example/a.pdf", "One two"), ("https://s.example/p/b.pdf", "b")]
    assert df.select(markup.title(F.col("html")).alias("t")).first().t == "Head"


def test_densest_text():
    page = "<nav><p>menu menu menu menu menu menu menu</p></nav><div id=a><p>short</p></div><div id=b><p>A paragraph that is long enough to count.</p><p>And another one of the kind, also long.</p></div><p>outside</p>"
    assert markup.densest_text(page) == "A paragraph that is long enough to count.\nAnd another one of the kind, also long."
    assert markup.densest_text(None) == "" and markup.densest_text("<p>just this</p>") == "just this"


def test_width_and_wrapping(spark):
    import unicodedata

    sample = "a한글 ○１ｱ（、漢あ😀é"
    wide = lambda t: sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t)
    assert all(got(spark, c, repro.display_width) == wide(c) for c in [*sample, sample])
    lines = got(spark, "- " + "가나다 " * 30 + "\n\n[ ] 12. " + "word " * 40, lambda c: repro.wrapped(c, indent=2))
    assert all(wide(x) <= 72 for x in lines) and "" in lines
    assert lines[0].startswith("  - 가") and lines[1].startswith("    가")
    box = lines[lines.index("") + 1 :]
    assert box[0].startswith("  [ ] 12. word") and all(x.startswith(" " * 10 + "word") for x in box[1:])
    assert got(spark, "가" * 50, repro.wrapped) == ["가" * 50] and got(spark, None, repro.wrapped) is None
    every = [chr(c) for c in range(0x20, 0x33000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(every[k : k + 997]) for k in range(0, len(every), 997)]
    rows = spark.createDataFrame([(b,) for b in blocks], "t string").select("t", repro.display_width(F.col("t")).alias("w")).collect()
    assert all(r.w == wide(r.t) for r in rows)


def test_wrapping_fills_lines_word_by_word(spark):
    """Against a plain fill of lines, at several widths."""
    import random
    import re
    import unicodedata

    wide = lambda t: sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t)
    r = random.Random(3)
    texts = ["\n".join(r.choice(["", "- ", "3. ", "[ ] 4. ", "[ ] [2] ", "  * "]) + " ".join(r.choice(["가나", "word", "", "a" * 30, "é"]) for _ in range(r.randrange(25))) for _ in range(3)) for _ in range(60)]
    for columns, indent in ((72, 0), (20, 2), (12, 3)):
        found = [x.y for x in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(repro.wrapped(F.col("t"), columns, indent).alias("y")).collect()]
        for text, lines in zip(texts, found):
            assert [x for x in "".join(lines) if x != " "] == [x for x in text if x not in " \n"]
            at = 0
            for line in text.split("\n"):
                if not line.strip():
                    assert lines[at] == ""
                    at += 1
                    continue
                mark = re.match(r"\s*(?:\[ \] \S+\s*|[-*]\s+|\d+\.\s+)?", line)[0]
                rows, used = [[]], indent + wide(mark)
                for word in line[len(mark) :].split(" "):
                    if rows != [[]] and used + 1 + wide(word) > columns:
                        rows.append([])
                        used = indent + wide(mark)
                    else:
                        used += rows != [[]]
                    used += wide(word)
                    rows[-1].append(word)
                for k, words in enumerate(rows):
                    assert lines[at] == ((" " * indent + mark if k == 0 else " " * (indent + wide(mark))) + " ".join(words)).rstrip(" ")
                    at += 1
            assert at == len(lines)


def test_plain_answers(spark):
    assert got(spark, " # Title\n## **Bold** x\n#\n\n- a **b**\ntext # no ", repro.plain_answer) == "Title\nBold x\n\n- a b\ntext # no"


def test_blank_boxes_are_not_graded(spark):
    marks = got(spark, "[O] a\r\n[ ] b\n[△] c\nx [O]\n[0.5] d", repro.marks)
    assert [(m.mark, m.rest) for m in marks] == [(1.0, "a"), (None, "b"), (0.5, "c"), (0.5, "d")]


def test_freeze_and_its_exit_codes(spark, tmp_path, capsys):
    from ragloom import __main__ as command

    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("one")
    settings, base = tmp_path / "s.json", str(tmp_path / "base")
    settings.write_text('{"model": {"k": 1}, "text:rules": "abc"}')
    run = lambda *more: command.main(["freeze", base, str(settings), "--files", str(tmp_path / "files"), *more], spark)
    assert run() == 1 and "no baseline" in capsys.readouterr().out
    assert run("--write") == 0 and run() == 0
    (tmp_path / "files" / "a.txt").write_text("two")
    settings.write_text('{"model": {"k": 1}, "text:rules": "abd"}')
    assert run() == 1
    told = capsys.readouterr().out
    assert "files > a.txt" in told and "rules" in told and "model" not in told


def test_rubrics_lose_their_prefix(spark):
    assert tuple(got(spark, "judgement: walk / a / b", lambda c: repro.rubric(c, "judgement:"))) == ("walk", ["a", "b"])
    assert got(spark, "walk / a", lambda c: repro.rubric(c, "judgement:")).judgement == "walk"


def test_snapshot_gate(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None)], "path string, value string")
    new = spark.createDataFrame([("a", "1"), ("c", None)], "path string, value string")
    assert repro.unchanged(old, old) and {r.path for r in repro.snapshot_diff(old, new).collect()} == {"b", "c"}


def test_failed_calls_are_rows(spark):
    def model(prompts):
        if "x" in prompts[0]:
            raise ValueError("no")
        return ["yes"]

    rows = models.ask(spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, prompt string"), model).collect()
    assert {r.query_id: r.answer for r in rows} == {1: "ERROR: no", 2: "yes"}


def test_each_missing_text_is_embedded_once(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    cache = models.embed(models.cache_misses(texts.filter("text = 'b'"), spark.createDataFrame([], "key string"), "m"))
    fresh = models.cache_misses(texts, cache, "m")
    assert [r.text for r in fresh.collect()] == ["a"]
    assert models.cache_upsert(cache, models.embed(fresh)).count() == 2


def test_upsert_is_idempotent(spark):
    schema = "url string, doc_id string, sha256 string, collected_on string, manual_verdict string, note string, license string"
    old = spark.createDataFrame([("u", "1", "h", "d1", "use", "n", "mine"), ("v", "2", "h2", "d1", "", "", "")], schema)
    fresh = spark.createDataFrame([("u", "h9", "d2", "cc"), ("w", "h3", "d2", "cc")], "url string, sha256 string, collected_on string, license string")
    first = catalog.upsert(old, fresh)
    assert {r.url: (r.status, r.note, r.license) for r in first.collect()} == {"u": ("updated", "n | changed d2 (before: 1_d1)", "mine"), "v": ("kept", "", None), "w": ("new", "", "cc")}
    again = catalog.upsert(first.drop("status"), fresh)
    assert {r.url: r.status for r in again.collect()} == {"u": "unchanged", "v": "kept", "w": "unchanged"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.jsonl").write_text('{"page": 1, "text": "x"}\n{"page": 2, "text": "y", "ocr": true}\n')
    (tmp_path / "t/a.txt").write_text("not this")
    (tmp_path / "t/b.txt").write_text("# whole\ntext")
    rows = sorted((r.doc_id, r.page, r.text, r.ocr) for r in readers.read_page_texts(spark, str(tmp_path / "t")).collect())
    assert rows == [("a", 1, "x", False), ("a", 2, "y", True), ("b", 0, "# whole\ntext", False)]
    (tmp_path / "q.csv").write_text("﻿" + ",".join(readers.QUESTIONS) + '\n1,,,,,"a, b",,,g:1\n2,,,,,c,,,\n', encoding="utf-8")
    questions = readers.read_questions(spark, str(tmp_path / "q.csv")).collect()
    assert [(q.number, q.question, q.disease) for q in questions] == [("1", "a, b", "")]
    chunks = spark.createDataFrame([("fixed", "c1", [1.0])], "strategy string, chunk_id string, vector array<double>")
    sinks.write_index(chunks, str(tmp_path / "i"))
    assert readers.read_index(spark, str(tmp_path / "i"), "fixed").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_index(spark, str(tmp_path / "i"), "other")
    sinks.write_lines(spark.createDataFrame([(7, 2, "b"), (7, 1, "a"), (8, 1, "c")], "sheet_id int, order int, line string"), str(tmp_path / "s"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "s/sheet_id=7").glob("part*")) == b"\xef\xbb\xbfa\r\nb\r\n"
    sinks.write_csv(spark.createDataFrame([("b", 1), ("a", 2)], "id string, n int"), str(tmp_path / "c"), "id")
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part*"))).startswith(b"\xef\xbb\xbfid,n")
    rows = spark.createDataFrame([("b", "h2"), ("a", "h1")], "key string, sha256 string")
    noted = readers.import_notes(rows, spark.createDataFrame([("a", "by hand"), ("b", "old")], "key string, note string"), "by hand").collect()
    assert [(r.key, r.note) for r in noted] == [("a", "by hand"), ("b", "old | by hand")]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("u", "2026-01-01 10:00:00", "h1"), ("u", "2026-01-01 11:00:00", "h2"), ("v", "2026-01-02 09:00:00", "h3")], "url string, ts string, sha256 string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        streams.append_stream(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    assert {(r.url, r.sha256, r.versions) for r in streams.latest_versions(events).collect()} == {("u", "h2", 2), ("v", "h3", 1)}
