"""More operators on small cases: plans under filters, catalogs, page texts, answers, sheets, kinds."""

import random

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from ragloom import __main__ as command
from ragloom.functions import text as T
from ragloom.operators import acquire, answers, building, catalog, chunking, dedup, markup, models, repro, textclean


def lambdas(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(")


def test_filters_and_explodes_repeat_no_lambda(spark):
    docs = spark.createDataFrame([(1, "One line.\nanother line\n\nlast")], "doc_id long, text string")
    paras = textclean.with_paragraphs(docs.select("doc_id", textclean.lines_of(F.col("text")).alias("lines")), "lines")
    plain = lambdas(paras.select("paragraphs"))
    assert plain < 12
    assert lambdas(paras.filter(F.size("paragraphs") > 0).select("paragraphs")) == plain
    assert lambdas(paras.select(F.explode("paragraphs").alias("p")).filter("p <> 'x'")) == plain
    units = docs.selectExpr("doc_id", "'t' as title", "'' as section", "'1' as label", "false as sectioned", "text")
    assert lambdas(chunking.fixed_chunks(units, True).filter("text <> ''")) < 20


def test_long_texts_are_cut_in_proportion(spark):
    import time

    took = []
    for n in (60_000, 240_000):
        rows = spark.createDataFrame([("word and words. " * (n // 16),)], "x string").repartition(1)
        began = time.time()
        pieces = rows.select(F.explode(T.settled(chunking.windows(F.col("x"), 500))).alias("p")).collect()
        took.append(time.time() - began)
        assert len(pieces) > n // 500 and all(len(p.p) <= 500 for p in pieces)
    assert took[1] < 10 * took[0] + 2


def test_running_states_and_parts_of_texts(spark):
    row = spark.createDataFrame([(list(range(300)), "aé😀" * 5000)], "x array<int>, t string")
    states = T.running(F.col("x"), F.lit(0), lambda a, x: a + x, "int", run=7)
    assert row.select(states.alias("y")).first().y == [k * (k + 1) // 2 for k in range(300)]
    text = "aé😀" * 5000
    for a, b in ((0, 3), (4094, 4099), (100, 14000), (14999, 15000), (5, 5)):
        assert row.select(T.part_of(T.blocks_of(F.col("t")), F.lit(a), F.lit(b)).alias("y")).first().y == text[a:b]


def test_rows_without_a_hash_stay(spark):
    rows = spark.createDataFrame([(1, None, False), (2, None, False), (3, "h", True), (4, "h", False)], "doc_id long, sha256 string, is_manual boolean").withColumn("first_id", F.lit("mine"))
    assert {r.doc_id: (r.dup_of, r.first_id) for r in catalog.with_exact_dup(rows).collect()} == {1: (None, "mine"), 2: (None, "mine"), 3: (4, "mine"), 4: (None, "mine")}


def test_a_long_chain_of_revisions_is_decided(spark):
    live = spark.createDataFrame([(k,) for k in range(60)], "doc_id long")
    pairs = spark.createDataFrame([(k, k + 1, 0.99) for k in range(59)], "a long, b long, jaccard double")
    got = {r.doc_id: r.excluded_by for r in dedup.content_exclusion(live, pairs).collect()}
    assert got == {k: (k - 1 if k % 2 else None) for k in range(60)}


def test_numbers_of_a_group_over_many_tasks(spark):
    rows = spark.createDataFrame([("hot" if k % 10 else "b", f"u{k:04d}") for k in range(500)], "source string, url string").repartition(7)
    got = sorted((r.source, r.n, r.url) for r in catalog.numbered(rows, "source", "url").collect())
    hot = [x for x in got if x[0] == "hot"]
    assert [x[1] for x in hot] == list(range(1, 451)) and [x[2] for x in hot] == sorted(x[2] for x in hot)


def test_ranges_that_cannot_be_read_are_told(spark):
    rows = spark.createDataFrame([("x/{page}", "a~b"), ("x/{page}", "2월 3일"), ("y", "bad")], "url string, page_range string")
    got = sorted((r.url, r.problem) for r in catalog.expand_urls(rows).collect())
    assert [g[0] for g in got] == ["x/2", "x/3", "x/{page}", "y"] and got[2][1] == "unreadable page range: a~b"
    assert all(p is None for u, p in got if u != "x/{page}")


# ---- page texts


class Plain(HTMLParser):
    """A page as nested lists, for a plain version of the densest text."""

    def __init__(self, html):
        super().__init__()
        self.root = self.at = ["", None, []]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in markup.VOID:
            self.at[2].append(node := [tag, self.at, []])
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node and node[0] != tag:
            node = node[1]
        if node and node[1]:
            self.at = node[1]

    def handle_data(self, data):
        self.at[2].append(data)


def walk(node, only=None):
    """Texts below a node, or its elements of some tags; what is dropped is left out."""
    for part in node[2]:
        if isinstance(part, str):
            if only is None and part.strip():
                yield part.strip()
        elif part[0] not in markup.DROPPED:
            if only and part[0] in only:
                yield part
            yield from walk(part, only)


def plain_densest(html):
    root = Plain(html).root

    def good(node):
        n = len(" ".join(walk(node)))
        return 0 if n < 20 or sum(len("".join(walk(a))) for a in walk(node, {"a"})) > n / 2 else n

    def above(node, tags):
        node = node[1]
        while node and node[0] not in tags:
            node = node[1]
        return node

    found = []
    for node in walk(root, markup.SCORED):
        holder = above(node, markup.HOLDERS)
        if good(node) and holder:
            for x in found:
                if x[0] is holder:
                    x[1] += good(node)
                    break
            else:
                found.append([holder, good(node)])
    if not found:
        return "\n".join(walk(root))
    best, most = max(found, key=lambda x: x[1])
    up = above(best, markup.HOLDERS - {"td"})
    if up and sum(map(good, walk(up, markup.SCORED))) > 1.3 * most:
        best = up
    return "\n".join(walk(best))


def test_densest_text_matches_a_plain_version(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    r = random.Random(2)
    for _ in range(300):
        tags = [r.choice(("<div>", "<p>", "</p>", "</div>", "<a>", "</a>", "<td>", "<section>", "<li>", "</section>", "<nav>", "</nav>", "<br>")) + " ".join(["word"] * r.choice((0, 1, 8))) for _ in range(r.randint(1, 25))]
        pages.append("".join(tags))
    for page in pages:
        assert markup.densest_text(page) == plain_densest(page), page
    assert markup.densest_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert markup.densest_text(None) == ""


def test_links_of_any_kind(spark):
    html = "<a href='../b'>one</a><a href=c?x=1>two</a><a class=k href = \"?p=2\">three</a><a href='#x'>no</a><a href='./d/./e/../f'>four</a>"
    pages = spark.createDataFrame([(1, "http://h/x/y/z.html?q", html)], "page_id long, url string, html string")
    assert [r.url for r in markup.links(pages).orderBy("pos").collect()] == ["http://h/x/b", "http://h/x/y/c?x=1", "http://h/x/y/z.html?p=2", "http://h/x/y/d/f"]


def test_kinds_are_parsed(spark):
    page = spark.createDataFrame([(1, "http://h/a/", "<h2>t</h2><div id=m><p>" + "text " * 9 + "</p></div><a href='x.pdf'>f</a>")], "page_id long, url string, html string")
    assert [r.url for r in acquire.parse_fetched(page, "page").collect()] == ["http://h/a/x.pdf"]
    (row,) = acquire.parse_fetched(page, "html", selector="#m").collect()
    assert (row.title, row.text) == ("t", ("text " * 9).strip())
    with pytest.raises(ValueError):
        acquire.parse_fetched(page, "other")
    lists = spark.createDataFrame([(1, "http://h/l", "<a href='view?1'>post one</a><a href='view?2'>two</a><a href='about'>x</a>")], "page_id long, url string, html string")
    posts = spark.createDataFrame([("http://h/view?1", "<a href='/f.pdf'>f</a>"), ("http://h/view?2", "none")], "url string, html string")
    assert [(r.title, r.url) for r in acquire.board_files(lists, posts, "view", "\\.pdf$").collect()] == [("post one", "http://h/f.pdf")]


def test_hidden_files_need_all_inputs(spark):
    one = '<input type="hidden" id="userFileName1" value="a.pdf" /> <input type="hidden" id="systemFileName1" value="s1" /><input type="hidden" id="titleId1" value="7" /><input type="hidden" id="fileId1" value="9" />'
    lost = '<input type="hidden" id="userFileName2" value="b.pdf" /><input type="hidden" id="titleId2" value="8" />'
    rows = spark.createDataFrame([(1, lost + one + "<a onclick=\"go('7')\">A title</a>")], "list_id long, html string")
    got = acquire.hidden_files(rows, "go\\('(\\d+)'\\)\">(.*?)</a>").collect()
    assert [(r.user_file, r.system_file, r.title_id, r.file_id, r.title) for r in got] == [("a.pdf", "s1", "7", "9", "A title")]


def test_names_in_other_encodings(spark):
    rows = [("plain.pdf",), ("한글.pdf".encode().decode("latin-1"),), ("한글.pdf".encode("euc-kr").decode("latin-1"),)]
    df = spark.createDataFrame([(f'attachment; filename="{r[0]}"',) for r in rows], "d string")
    assert [r.n for r in df.select(acquire.download_name(F.col("d"), F.lit("http://h/x")).alias("n")).collect()] == ["plain.pdf", "한글.pdf", "한글.pdf"]


# ---- answers and sheets


def test_a_lost_question_is_an_error(spark):
    words = answers.Vocabulary("no", "ask", "d", "x", "y", "Refs")
    results = spark.createDataFrame([("r", 1, "a", None, None)], "result string, number long, answer string, verdict string, sources string")
    questions = spark.createDataFrame([(2, "k", "", "q", ["g"])], "number long, kind string, explicit string, question string, gold array<string>")
    with pytest.raises(Exception, match="no question of number 1"):
        answers.check_answers(results, questions, words).collect()


def test_answers_are_asked_for_again(spark):
    rules = models.Rules("out: %s", "left out: %s", " please\\?$", "diagnose", "stated", "[0-9]", "You are ill", "Take more pills", "Refs")
    questions = spark.createDataFrame([(1, "walk please?", "in", [], None), (2, "both", "partial", ["gout"], "only this"), (3, "gout", "out", ["gout"], None), (4, "pills 1", "in", [], None), (5, "diagnose me", "in", [], None)], "query_id long, question string, scope string, out_of_scope array<string>, rewritten string")
    asked = []

    def search(rows):
        asked.extend(sorted((r.query_id, r.text) for r in rows.collect()))
        return rows.select("query_id", F.lit(1).alias("rank"), F.lit("T (d) 1쪽").alias("cite"), F.lit(0.5).alias("score"), F.lit("found").alias("text"))

    def model(prompts):
        out = []
        for p in prompts:
            if "fails" in p:
                raise RuntimeError("down")
            if "pills" in p.split("\n")[0] or "pills 1" in p:
                out.append("Fine. Take more pills. Walk on." if "The last answer" not in p else "Take more pills. Walk on.")
            else:
                out.append("You are ill. Rest." if "diagnose" in p and "The last" not in p else "Rest.")
        return out

    done = {r.query_id: r for r in models.run(questions, rules, search, model).collect()}
    assert asked == [(1, "walk"), (2, "only this"), (4, "pills 1"), (5, "diagnose me")]
    assert done[3].answer == "out: gout" and done[3].sources == "" and done[3].asked is None
    assert done[2].answer == "Rest.\n\nleft out: gout" and done[1].answer == "Rest."
    assert done[4].answer == "Walk on." and done[5].answer == "Rest." and done[5].diagnosis
    assert done[1].sources == "[1] T (d) 1쪽 (0.50)"
    failed = models.report(models.baseline(spark.createDataFrame([(1, "fails")], "query_id long, question string"), model), "m", F.lit("s")).first()
    assert failed.failed and failed.answer == "ERROR: down" and failed.memo == ""


def test_a_judge_clears_or_names_a_sentence(spark, tmp_path):
    """What the judge clears stays as it was, without a second call; what it names goes, and only that."""
    rules = models.Rules("out: %s", "left out: %s", "x^", "x^", "x^", "x^", "x^", "pills|약", "Refs")
    questions = spark.createDataFrame([(k, q, "in", [], None) for k, q in enumerate(("doctor?", "more?", "breaks?", "none?", "korean?", "mended?"))], "query_id long, question string, scope string, out_of_scope array<string>, rewritten string")
    said = {
        "doctor?": "- - Ask a doctor about pills. Walk.", "more?": "Take more pills. Ask a doctor about pills. Walk.", "breaks?": "Take more pills. Walk.", "none?": "Walk.",
        "korean?": "약을 끊으세요 걷기는 좋다 약은 의사와 상의한다", "mended?": "Take more pills.",
    }

    def model(prompts):
        for p in prompts:
            with open(tmp_path / "asked", "a") as f:
                f.write(next(q for q in said if q in p) + "\n")
        return ["Walk." if "mended?" in p and "The last" in p else next(a for q, a in said.items() if q in p) for p in prompts]

    def judge(sentences):
        if "pills. Walk" in sentences or "Walk" in sentences.split("\n"):
            raise AssertionError("not a candidate")
        return next((s for s in sentences.split("\n") if s.startswith(("Take more", "약을"))), "")

    search = lambda rows: rows.select("query_id", F.lit(1).alias("rank"), F.lit("c").alias("cite"), F.lit(0.5).alias("score"), F.lit("t").alias("text"))
    done = {r.asked: r.answer for r in models.run(questions, rules, search, model, judge=judge).collect()}
    assert done["doctor?"] == "- Ask a doctor about pills. Walk." and done["none?"] == "Walk."
    assert done["more?"] == "Ask a doctor about pills. Walk." and done["breaks?"] == "Walk." and done["mended?"] == "Walk."
    assert done["korean?"] == "걷기는 좋다 약은 의사와 상의한다"
    asked = (tmp_path / "asked").read_text().split()
    assert {q: asked.count(q) for q in said} == {"doctor?": 1, "none?": 1, "more?": 2, "breaks?": 2, "mended?": 2, "korean?": 2}
    plain = {r.asked: r.answer for r in models.run(questions, rules, search, model).collect()}
    assert plain["doctor?"] == "Walk." and plain["more?"] == "Walk."


def test_sentences_end_as_stated(spark):
    row = spark.createDataFrame([("약을 끊는다 걷는다. 약을 먹어요 좋다",)], "t string")
    assert row.select(answers.candidates(F.col("t"), "약", "Refs").alias("y")).first().y == ["약을 끊는다", "약을 먹어요"]
    assert row.select(answers.drop_sentences(F.col("t"), "약", "Refs").alias("y")).first().y == "걷는다. 좋다"
    assert row.select(answers.candidates(F.col("t"), "약", "Refs", ".").alias("y")).first().y == ["약을 끊는다 걷는다.", "약을 먹어요 좋다"]
    assert row.select(answers.drop_sentences(F.col("t"), F.lit("끊"), "Refs").alias("y")).first().y == "걷는다. 약을 먹어요 좋다"


def test_models_wait_and_try_again():
    calls, waits = [], []

    def model(batch):
        calls.append(batch)
        if len(calls) < 4:
            raise models.RateLimited
        return batch

    assert models.Retrying(model, sleep=waits.append)(["a"]) == ["a"] and waits == [5.0, 10.0, 20.0]
    calls.clear()
    with pytest.raises(models.RateLimited):
        models.Retrying(model, tries=3, sleep=waits.append)(["a"])


def test_a_filled_sheet_is_read_back(spark):
    rows = spark.createDataFrame([(1, "k", "Why?", "in: so", ["in"], "# An **answer** [1].", "yes", ["one", "two"]), (2, "k", "How?", None, ["out"], "none", "no", [])], "number long, kind string, question string, verdict string, expected array<string>, answer string, judgement string, details array<string>")
    texts = spark.createDataFrame([(1, 1, "source\n text", True), (1, 2, "other", False)], "number long, rank int, text string, cited boolean")
    lines = [r.line for r in repro.sheet_lines(rows, texts, "sheet").orderBy("part", "line_no").collect()]
    sheet = "\n".join(lines)
    assert "[scope] O expected: in" in sheet and "  An answer [1]." in sheet and "  [ ] [1] source text" in sheet and "  [2] other" in sheet
    filled = sheet.replace("[ ] judgement yes", "[O] judgement yes").replace("[ ] 1. one", "[△] 1. one").replace("[ ] [1]", "[X] [1]").replace("violations:    ", "violations: 2 ", 1)
    got = {r.number: r for r in repro.parse_sheet(spark.createDataFrame([(1, filled)], "sheet_id long, text string")).collect()}
    assert (got[1].judgement, got[1].detail_score, got[1].details_graded, got[1].details) == (1.0, 0.5, 1, 2)
    assert (got[1].cites_right, got[1].cites_graded, got[1].cites, got[1].violations, got[1].scope) == (0, 1, 1, 2, "O")
    assert (got[2].judgement, got[2].details, got[2].violations, got[2].scope) == (None, 0, None, "")


def test_an_index_embeds_only_what_the_cache_lacks(spark):
    chunks = spark.createDataFrame([("c1", "a"), ("c2", "a"), ("c3", "b")], "chunk_id string, text string")
    cache = models.embed(chunks.filter("text = 'b'").select(models.cache_key("m", F.col("text")).alias("key"), "text"))
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return models.hash_embedder(texts)

    index, known = building.build_index(chunks, cache, "m", model)
    assert index.count() == 3 and known.count() == 2 and seen.value == 1


def test_command_line(spark, tmp_path, capsys):
    assert command.main(["list"]) == 0 and "chunk_build" in capsys.readouterr().out
    assert command.main(["run", "url_site_key", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    assert command.main(["run", "url_site_key", "/root/testdata/sf0.001", "--dry-run"], spark) == 0
