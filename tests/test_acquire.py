"""Decisions around fetching."""

from pyspark.sql import functions as F

from ragloom.operators import acquire


def test_policies(spark):
    df = spark.createDataFrame([(404,), (403,), (None,), (200,)], "s int")
    assert [r.p for r in df.select(acquire.robots_policy(F.col("s")).alias("p")).collect()] == ["allow", "deny", "deny", "rules"]
    gaps = spark.createDataFrame([(3.0, 10.0, None), (3.0, None, None), (3.0, 10.0, 1.0)], "d double, c double, g double")
    assert [r.g for r in gaps.select(acquire.request_gap(F.col("d"), F.col("c"), F.col("g")).alias("g")).collect()] == [10.0, 3.0, 1.0]


def test_download_names(spark):
    cases = [
        ("attachment; filename=\"a.pdf\"; filename*=UTF-8''%ED%95%9C.pdf", "https://s/x", "한.pdf"),
        ('inline; filename="a b.pdf"', "https://s/x", "a b.pdf"),
        (None, "https://s/d/c%20d.pdf?z=/q", "c d.pdf"),
        ("", "https://s/", "download"),
        ("attachment; filename=report.pdf", "https://s/other.txt", "report.pdf"),
        ("attachment; filename=a+b%20c.pdf; size=3", "https://s/x", "a+b c.pdf"),
        ('attachment; filename="%ED%95%9C.pdf"', "https://s/x", "한.pdf"),
        ("attachment; filename=\"50% off.pdf\"", "https://s/x", "50% off.pdf"),
    ]
    df = spark.createDataFrame(cases, "d string, u string, w string")
    assert all(r.n == r.w for r in df.select("w", acquire.download_name(F.col("d"), F.col("u")).alias("n")).collect())


def test_stated_ids(spark):
    df = spark.createDataFrame([("PMC12, pmc3;",), ("PMC12 and more",), ("",)], "q string")
    assert [r.i for r in df.select(acquire.stated_ids(F.col("q")).alias("i")).collect()] == [["12", "3"], None, None]
    assert df.limit(1).select(acquire.content_numbers(F.col("q")).alias("i")).first().i == ["12", "3"]


def test_hidden_files(spark):
    hidden = lambda k, name, title: f'<input id="userFileName{k}" value="{name}"/><input type="hidden" id="systemFileName{k}" value="s{k}"/><input id="titleId{k}" value="{title}"/><input id="fileId{k}" value="{k}"/>'
    html = hidden(1, "a.PDF", 7) + hidden(2, "b.hwp", 7) + hidden(3, "c.pdf", 9) + "<a href=\"fn('7')\">The <b>post</b></a>"
    df = spark.createDataFrame([(1, html)], "list_id long, html string")
    rows = acquire.hidden_files(df, "fn\\('(\\d+)'\\)\">(.*?)</a>").collect()
    assert sorted((r.user_file, r.system_file, r.file_id, r.title) for r in rows) == [("a.PDF", "s1", "1", "The post"), ("c.pdf", "s3", "3", "")]


def test_attachments(spark):
    many = "".join(f'<a href="/f{k}.pdf">f</a>' for k in range(5))
    rows = [(1, "https://s/p", f'<meta name="citation_pdf_url" content="https://s/m.pdf">{many}'), (2, "https://s/p", many), (3, "https://s/p", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.url) for r in acquire.attachments(df, "\\.pdf").collect())
    assert got == [(1, "https://s/m.pdf"), (2, "https://s/f0.pdf"), (2, "https://s/f1.pdf"), (2, "https://s/f2.pdf")]


def test_page_plan(spark):
    pages = [("a", k, 5 if k < 2 else 900, 150 if k == 0 else 20) for k in range(10)] + [("b", k, 0, 500) for k in range(10)]
    df = spark.createDataFrame(pages, "doc string, page int, n_chars int, ocr_chars int")
    assert {r.doc: (r.n_pages, r.n_empty, r.recognise, r.n_ocr) for r in acquire.page_plan(df).collect()} == {"a": (10, 2, True, 1), "b": (10, 10, False, 0)}
