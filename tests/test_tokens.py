"""The reader of HTML: events of plain pages as the standard library gives them, any bytes in linear time."""

import random
import time
from html.parser import HTMLParser

import pytest

from ragloom.operators import markup
from ragloom.operators.tokens import Reader, characters


def events(base, page):
    class Told(base):
        def __init__(self):
            super().__init__()
            self.out = []

        def handle_starttag(self, tag, attrs):
            self.out.append(("start", tag, attrs))

        def handle_endtag(self, tag):
            self.out.append(("end", tag))

        def handle_data(self, data):
            self.out.append(("text", data))

    told = Told()
    told.feed(page)
    told.close()
    return told.out


PAGES = [
    "<!DOCTYPE html><html><head><title>a &amp; b</title><script>if (a<b) x('</p>')</script></head><body class=main id='x'><p>one<br/>two &lt;three&gt;</p></body></html>",
    "<ul><li>a<li data-x=1 checked>b</ul><!-- <p>no</p> --><A HREF=\"/u?a=1&amp;b=2\">L&eacute;a</A>",
    "<p title='a > b'>x</p ><style>p > a { }</style><textarea><b>raw</b></textarea>",
    "text only", "", "<p>é😀<img src=a.png alt=''>",
]


@pytest.mark.parametrize("page", PAGES)
def test_plain_pages_give_the_events_of_the_standard_parser(page):
    told = events(Reader, page)
    if "textarea" in page:  # of which older versions of that one make elements
        assert ("text", "<b>raw</b>") in told
    else:
        assert told == events(HTMLParser, page)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>a<![foo[x]]>b</p>", "a b"), ("a<![>b", "a b"), ("<p>a<![endif]-->b</p>", "a b"), ("x<?php echo 1 ?>y", "x y"), ("a < b", "a < b"), ("<p>a<", "a<"), ("1 <2", "1 <2"),
        ("a<!-->b", "a b"), ("a<!-- never ends", "a"), ("a<b c='never ends", "a"), ("</>a</ x>b", "a b"), ("<p a=b=c d= >x", "x"), ("a&#xD800;&#999999999999999999;&bogus;&", "a��&bogus;&"), ("<script>x", "x"), ("<title>x<p>y", "x y"),
    ],
)
def test_broken_markup(page, text):
    assert " ".join(e[1] for e in events(Reader, page) if e[0] == "text") == text


def test_numbers_of_any_length_are_characters():
    assert characters("&#" + "9" * 6000 + ";&#x" + "f" * 6000 + ";&#65;") == "��A"


@pytest.mark.parametrize("bit", ["<a b='", "<a b=\"", "<![", "<!--", "<", "</", "<p ", "<a =", "&#", "<title>", "<script>", "<script></scrip", "<p a=1 ", "<div>", "</div>", "<p><b>", "<a    ", "<?"])
def test_a_megabyte_of_broken_markup_takes_little_time(bit):
    page = bit * (1_000_000 // len(bit))
    began = time.time()
    events(Reader, page)
    assert time.time() - began < 5
    began = time.time()
    markup.densest_text(page[:300_000])
    assert time.time() - began < 5


def test_mutated_pages_never_fail(spark, sf_dir):
    rng = random.Random(1)
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect() if r.html]
    bits = ["<", ">", "<![", "<!--", "-->", "'", '"', "=", "&#", "\0", "</", "<p", "/>", "]]>", "\ud800", "<svg><title>", "<script>"]
    for k in range(10_000):
        page = rng.choice(pages)
        at = rng.randrange(len(page))
        page = page[max(0, at - 400) : at] + rng.choice(bits) + page[at + rng.randrange(3) : at + 400]
        assert isinstance(markup.densest_text(page, "div p" if k % 2 else None), str)
