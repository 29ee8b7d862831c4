"""Pages are given to each stage once, errors are rows."""

from ragloom.operators import acquire, crawl, recognise
from ragloom.sources import readers

PAGES = "doc string, page int, text string, image binary"


def noted(folder):
    """A stand-in that writes down what it is given."""

    def read(image, resolution):
        name = image.decode()[:12].replace(" ", "_")
        with open(f"{folder}/{name}-{resolution}", "a") as f:
            f.write("x")
        if "bad" in name or (resolution == recognise.PRECISE and "late" in name):
            raise RuntimeError("no")
        return image.decode() + (" fine" if resolution == recognise.PRECISE else " rough")

    return read


def test_two_stages_and_a_cache(spark, tmp_path):
    long = " text" * 40
    rows = [("a", k, t, None if i is None else bytearray(i.encode())) for k, (t, i) in enumerate([("has text of its own already", "p0" + long), (" ", "p1" + long), ("", "cover"), (None, "bad" + long), ("", None), ("", "late" + long), ("enough of a text on this page", "x"), ("and on this one there is, too", "x")])]
    rows += [("scan", k, "", bytearray(f"s{k}{long}".encode())) for k in range(3)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    cache = spark.createDataFrame([], "doc string, page int, resolution int, text string")
    told, cache = recognise.recognised(pages, cache, noted(tmp_path))
    found = {(r.doc, r.page): (r.text, r.ocr, r.error) for r in told.collect()}
    assert found["a", 0] == (rows[0][2], False, None) and found["a", 1] == (f"p1{long} fine", True, None) and found["a", 2] == ("", False, None)
    assert found["a", 3] == (None, False, "RuntimeError: no") and found["a", 4] == ("", False, "no image")
    assert found["a", 5] == (f"late{long} rough", True, "RuntimeError: no")
    assert all(found["scan", k] == ("", False, None) for k in range(3)) and len(found) == len(rows)
    told.count()
    given = {f.name: len(f.read_text()) for f in tmp_path.iterdir()}
    assert set(given.values()) == {1} and {k.split("-")[0][:2] for k in given} == {"p1", "co", "ba", "la"}
    # again: only what failed
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    again = {(r.doc, r.page): (r.text, r.ocr, r.error) for r in recognise.recognised(pages, cache, noted(tmp_path))[0].collect()}
    assert again == found
    more = {f.name: len(f.read_text()) - given[f.name] for f in tmp_path.iterdir()}
    assert {k for k, n in more.items() if n} == {k for k in more if k.startswith("bad") or (k.startswith("late") and k.endswith(str(recognise.PRECISE)))}


def test_without_a_recogniser_pages_stay(spark):
    pages = spark.createDataFrame([("a", 1, "", None)], PAGES)
    told, cache = recognise.recognised(pages, spark.createDataFrame([], "doc string, page int, resolution int, text string"), None)
    assert [tuple(r) for r in told.collect()] == [("a", 1, "", False, None)] and cache.count() == 0


def test_files_of_mixed_kinds(spark, tmp_path):
    files = {"html/a.html": "<h1>Müller</h1><![x[<p>Größe".encode("latin-1"), "pmc/b.xml": b"<no", "kdca/c.xml": b"<r><HEAD><CODE>S001</CODE></HEAD><svc><CNTNTSSJ>t</CNTNTSSJ></svc></r>", "pdf/d.pdf": b"%PDF", "page/e.html": b'<a href="/f.pdf">f</a>', "ftp/g": b"x", "khepi/h.html": b"x"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    raw = readers.read_fetched(spark, str(tmp_path))
    fetched = raw.select("key", "kind").join(crawl.decoded(raw).select("key", "text"), "key").selectExpr("key", "kind", "'http://s/x' AS url", "text AS html")
    rows = {r.kind: r for r in acquire.parse_mixed(fetched).collect()}
    assert rows["html"].text == "Müller\nGröße" and rows["html"].title == "Müller" and rows["html"].what == "text"
    assert rows["pmc"].what == "error" and rows["kdca"].title == "t" and rows["pdf"].what == "file"
    assert rows["page"].url == "http://s/f.pdf" and rows["ftp"].error == "unknown kind ftp" and rows["khepi"].error == "unknown kind khepi"
    with_form = acquire.parse_mixed(fetched, {"khepi": {"post": "fn\\('(\\d+)'\\)\">(.*?)</a>"}})
    assert {r.kind for r in with_form.collect()} == {"html", "pmc", "kdca", "pdf", "page", "ftp"}
