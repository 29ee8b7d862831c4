"""Operator 1: main text of web pages by a recurrent block labeller.

A page is split into blocks, the texts between starts and ends of block-level elements. Each block is a vector:
the hashed tags and class words of its path, its hashed words, and a few shares. A bidirectional LSTM in numpy
reads the page's blocks in order and labels each as article or not, so that what stands before and after counts.
It is trained on pages that ``sample_page`` makes, whose blocks' labels are known; training is seeded and takes
some seconds, once for each driver process.

Nulls: a null or empty html has no blocks: text "". A null page_id or url is kept. Very long and very deep pages are
read whole: a path is shared by the elements below it and its features are kept as bits, vectors are made some
thousand blocks at a time, and both directions carry their state over all of a page's blocks. A block of just 0.5 isn't
article. Repeated rows are labelled alike. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tokens import Reader
from .common import small_batches

#: Elements whose start and end separate blocks.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style head title template noscript iframe textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the start of another of the same kind ends.
SIBLINGS = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CONTAINERS = frozenset("article aside blockquote body button div dl fieldset footer form header li main menu nav ol section table td th ul".split())
TAGS, CLASSES, WORDS, SHARES = 48, 64, 48, 8
WIDTH = 2 * TAGS + CLASSES + WORDS + SHARES
#: Blocks that go through the network at once, as a batch of pages or as a part of one.
HIDDEN_UNITS, BATCH, BATCH_BLOCKS = 20, 64, 8192
TRAIN_PAGES, EPOCHS, SEED = 2000, 5, 3


class _Buckets(dict):
    """Hash buckets of strings, forgotten when there are many."""

    def __init__(self, size: int, kept: int = 300_000) -> None:
        super().__init__()
        self.size, self.kept = size, kept

    def __missing__(self, key: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        out = self[key] = zlib.crc32(key.encode("utf-8", "surrogatepass")) % self.size
        return out


_TAGS, _CLASSES, _WORDS = _Buckets(TAGS), _Buckets(CLASSES), _Buckets(WORDS)


class Node:
    """An open element: its tag, and the features of its whole path as bits: tags, then class words."""

    __slots__ = ("bits", "depth", "names", "tag")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None) -> None:
        self.tag, self.names, self.depth = tag, names, parent.depth + 1 if parent else 1
        self.bits = (parent.bits if parent else 0) | 1 << _TAGS[tag]
        for name in names:
            self.bits |= 1 << (TAGS + _CLASSES[name])


class Blocks(Reader):
    """Collects (innermost open element or None, text, characters in links) of each block with text."""

    def __init__(self) -> None:
        super().__init__()
        self.path: list[Node] = []
        self.open: Counter = Counter()
        self.hidden = 0
        self.found: list[tuple[Node | None, str, int]] = []
        self._texts: list[str] = []
        self._links = 0
        self._at: Node | None = None

    def _end_block(self) -> None:
        if self._texts:
            text = " ".join("".join(self._texts).split())
            if text:
                self.found.append((self._at, text, self._links))
            self._texts, self._links = [], 0

    def _close(self, k: int) -> None:
        """End the k-th open element and all within it."""
        for gone in self.path[k:]:
            self.open[gone.tag] -= 1
            self.hidden -= gone.tag in HIDDEN
        del self.path[k:]

    def _pop(self, tags: str) -> None:
        """End open elements among ``tags``, from the innermost one, up to the next container or hidden element."""
        wanted, k = tags.split(), len(self.path) - 1
        while k >= 0 and any(self.open[t] for t in wanted):
            tag = self.path[k].tag
            if tag in wanted:
                self._close(k)
            elif tag in CONTAINERS or tag in HIDDEN:
                return
            k -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            if not self.hidden:
                self._end_block()
            self._pop(SIBLINGS.get(tag, "p"))
        if tag == "br":
            self._texts.append(" ")
        if tag in VOID:
            return
        if tag == "body" and self.hidden:
            for k in range(len(self.path) - 1, -1, -1):
                if self.path[k].tag in HIDDEN:
                    self._close(k)
        known = dict(attrs)
        names = re.findall("[a-z]+", f"{known.get('class') or ''} {known.get('id') or ''} {known.get('role') or ''}".lower())
        self.path.append(Node(tag, tuple(names), self.path[-1] if self.path else None))
        self.open[tag] += 1
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and not self.hidden:
            self._end_block()
        if self.open[tag]:
            k, hidden = len(self.path) - 1, self.hidden
            while self.path[k].tag != tag:
                k -= 1
            self._close(k)
            if tag in BLOCKS and hidden and not self.hidden and tag not in HIDDEN:
                self._end_block()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if not self._texts:
            self._at = self.path[-1] if self.path else None
        self._texts.append(data)
        if self.open["a"]:
            self._links += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_block()


def blocks(html: str | None) -> list[tuple[Node | None, str, int]]:
    """The blocks of a page in order."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.found


def vectors(found: list[tuple[Node | None, str, int]], start: int = 0, end: int | None = None) -> np.ndarray:
    """A row for each block from ``start`` to before ``end``: tags of its path, its own tag, class words, words, shares."""
    some = found[start:end]
    out = np.zeros((len(some), WIDTH), np.float32)
    bits = b"".join((node.bits if node else 0).to_bytes((TAGS + CLASSES) // 8, "little") for node, *_ in some)
    flags = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
    out[:, :TAGS], out[:, 2 * TAGS : 2 * TAGS + CLASSES] = flags[:, :TAGS], flags[:, TAGS:]
    for k, (node, text, links) in enumerate(some):
        row = out[k]
        if node:
            row[TAGS + _TAGS[node.tag]] = 1
        words = text.lower().split()
        counts = np.bincount([_WORDS[w] for w in words], minlength=WORDS)
        at = 2 * TAGS + CLASSES
        row[at : at + WORDS] = counts / np.sqrt((counts * counts).sum())
        n, chars = len(words), len(text)
        row[at + WORDS :] = (min(np.log1p(n) / 6, 2), min(1, links / chars), text[-1] in ".!?…:;\"'”»", min((node.depth if node else 0) / 12, 1), "©" in text or "(c)" in text, (start + k) / len(found), chars / max(1, n) / 12, n < 4)
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, seed: int = SEED, units: int = HIDDEN_UNITS) -> None:
        r = np.random.default_rng(seed)
        self.units = units
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.08, (WIDTH, 4 * units)).astype(np.float32)
            self.p[f"h{d}"] = r.normal(0, 0.15, (units, 4 * units)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * units, np.float32)
            self.p[f"c{d}"][units : 2 * units] = 1  # forget gates start open
        self.p["o"] = r.normal(0, 0.2, (2 * units,)).astype(np.float32)
        self.p["z"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True, state: list | None = None) -> tuple[np.ndarray, list]:
        """States of one direction over x (batch, steps, WIDTH); a masked step keeps the state. keep: for gradients.

        ``state`` holds what the direction starts from, and afterwards what it ends with.
        """
        u, n, steps = self.units, len(x), x.shape[1]
        drive = (x.reshape(-1, WIDTH) @ self.p[f"x{d}"]).reshape(n, steps, 4 * u) + self.p[f"c{d}"]
        h, c = state or (np.zeros((n, u), np.float32), np.zeros((n, u), np.float32))
        out, kept = np.zeros((n, steps, u), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = drive[:, t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-a[:, : 3 * u]))
            g = np.tanh(a[:, 3 * u :])
            i, f, o = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :]
            new = f * c + i * g
            tanh = np.tanh(new)
            m = mask[:, t : t + 1]
            if keep:
                kept.append((t, h, c, i, f, o, g, tanh, m))
            h, c = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * c
            out[:, t] = h
        if state is not None:
            state[:] = [h, c]
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The chance of each block to be article."""
        both = np.concatenate([self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]], 2)
        return 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["z"])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean cross-entropy, by back-propagation through time."""
        u, runs = self.units, {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        p = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["z"])))
        err = ((p - y) * mask / mask.sum()).astype(np.float32)
        grad = {"o": np.einsum("bt,btu->u", err, both), "z": np.array([err.sum()], np.float32)}
        for k, d in enumerate("fb"):
            dout = err[:, :, None] * self.p["o"][k * u : (k + 1) * u]
            da_all = np.zeros((*x.shape[:2], 4 * u), np.float32)
            dh, dc, gh = np.zeros((len(x), u), np.float32), np.zeros((len(x), u), np.float32), np.zeros((u, 4 * u), np.float32)
            for t, h0, c0, i, f, o, g, tanh, m in reversed(runs[d][1]):
                dh = dh + dout[:, t]
                dnew = m * (dc + dh * o * (1 - tanh * tanh))
                da = np.concatenate([dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), m * dh * tanh * o * (1 - o), dnew * i * (1 - g * g)], 1)
                da_all[:, t] = da
                gh += h0.T @ da
                dh = da @ self.p[f"h{d}"].T + (1 - m) * dh
                dc = dnew * f + (1 - m) * dc
            grad[f"x{d}"] = x.reshape(-1, WIDTH).T @ da_all.reshape(-1, 4 * u)
            grad[f"h{d}"], grad[f"c{d}"] = gh, da_all.sum((0, 1))
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 32, seed: int = SEED) -> Labeller:
        """Adam over batches of pages of like length."""
        r = np.random.default_rng(seed)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        for epoch in range(epochs):
            for at in r.permutation(len(groups)):
                x, mask = padded([pages[k][0] for k in groups[at]])
                y = padded([pages[k][1][:, None] for k in groups[at]])[0][:, :, 0]
                t += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * 0.5**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[tuple[Node | None, str, int]]]) -> list[np.ndarray]:
        """For each page's blocks, which are article. Pages of like length go together; a long one goes in parts."""
        out = [np.zeros(len(x), bool) for x in pages]
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            if longest > BATCH_BLOCKS:
                out[k] = self._label_long(pages[k := order.pop()])
                continue
            size = min(BATCH, BATCH_BLOCKS // longest)
            some, order = order[-size:], order[:-size]
            for k, row in zip(some, self.scores(*padded([vectors(pages[k]) for k in some])), strict=True):
                out[k] = row[: len(out[k])] > 0.5
        return out

    def _label_long(self, found: list[tuple[Node | None, str, int]]) -> np.ndarray:
        """The same for one page, a part at a time: forward over all parts, then backward, with the state carried over."""
        parts = [(at, min(at + BATCH_BLOCKS, len(found))) for at in range(0, len(found), BATCH_BLOCKS)]
        sums, u = np.full(len(found), self.p["z"][0], np.float32), self.units
        for k, (d, order) in enumerate((("f", parts), ("b", parts[::-1]))):
            state: list = []
            for start, end in order:
                x = vectors(found, start, end)[None]
                sums[start:end] += (self._run(x, np.ones(x.shape[:2], np.float32), d, False, state)[0] @ self.p["o"][k * u : (k + 1) * u])[0]
        return 1 / (1 + np.exp(-sums)) > 0.5


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different lengths as one array, and where it has something."""
    steps = max(map(len, rows))
    x, mask = np.zeros((len(rows), steps, rows[0].shape[1]), np.float32), np.zeros((len(rows), steps), np.float32)
    for k, row in enumerate(rows):
        x[k, : len(row)], mask[k, : len(row)] = row, 1
    return x, mask


#: Words that menus, notices, adverts, forms and comments often have, for the made pages.
CUES = {
    "menu": "home about contact login search menu categories archive news products blog help sitemap next previous more",
    "notice": "cookies cookie consent accept privacy policy notice subscribe newsletter sign up javascript browser",
    "advert": "sponsored advertisement buy now offer sale shop discount free deal",
    "footer": "copyright © all rights reserved terms privacy imprint powered by",
    "comment": "comments reply said posted by user likes ago thanks great agree",
    "form": "email name password submit send message subscribe search your",
    "related": "related articles read more you may also like share facebook twitter popular tags",
}


def sample_page(r: random.Random) -> tuple[str, list[int]]:
    """A made page and its blocks' labels: 1 for the article."""
    syllables = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouäéóü") + r.choice(["", "n", "r", "s"]) for _ in range(1)) for _ in range(40)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
    noise = r.choice(("", "", "", "", "!!", "***", "&amp;", "%%%"))
    upper = r.random() < 0.08

    def some(low: int, high: int, cue: str = "") -> str:
        out = [word() + (noise if r.random() < 0.9 else "") for _ in range(r.randint(low, high))]
        if cue and r.random() < 0.6:
            out[r.randrange(len(out)) :] = r.sample(CUES[cue].split(), r.randint(1, 4))
        text = " ".join(out)
        return text.upper() if upper else text[:1].upper() + text[1:]

    labels: list[int] = []

    def block(tag: str, text: str, label: int, attrs: str = "", close: bool = True) -> str:
        labels.append(label)
        return f"<{tag}{attrs}>{text}" + (f"</{tag}>" if close else "")

    def named(*names: str) -> str:
        kind = r.random()
        return f' class="{r.choice(names)}"' if kind < 0.6 else f' id="{r.choice(names)}"' if kind < 0.8 else f' class="{r.choice(("col", "wrap", "box", "row"))} {r.choice(names)}"'

    def menu() -> str:
        lines = "".join(block("li", f'<a href="/{word()}">{some(1, 3, "menu")}</a>', 0) for _ in range(r.randint(2, 8)))
        lists = f"<ul>{lines}</ul>"
        return r.choice((f"<nav>{lists}</nav>", f"<div{named('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'topbar')}>{lists}</div>", f"<header>{lists}</header>", f"<nav{named('main', 'site', 'top')}>{lists}</nav>"))

    def aside() -> str:
        kind = r.choice(("aside", "ad", "notice", "form", "related", "header", "ad"))
        short, long = r.randint(0, 1), r.randint(4, 30)
        if kind == "ad":
            return block("div", some(3, long, "advert"), 0, named("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "ad"))
        if kind == "notice":
            inner = block("p", some(4, long, "notice"), 0)
            return f"<div{named('notice', 'cookie', 'consent', 'alert', 'popup', 'message', 'warning', 'gdpr')}>{inner}</div>"
        if kind == "form":
            inner = block("label", some(1, 3, "form"), 0) if short else block("p", some(2, 8, "form"), 0)
            return f'<form action="/go"{named("search", "subscribe", "login", "newsletter")}>{inner}<input name="q"></form>'
        if kind == "related":
            lines = "".join(block("li", f'<a href="/{word()}">{some(3, 9, "related")}</a>', 0) for _ in range(r.randint(2, 5)))
            return f"<div{named('related', 'share', 'social', 'popular', 'recommended', 'tags', 'widget')}><ul>{lines}</ul></div>"
        if kind == "header":
            return f"<header{r.choice(('', named('site', 'page', 'masthead', 'top')))}>{block('div', some(1, 6), 0)}</header>"
        inner = block(r.choice(("h3", "h4", "p")), some(1, 4), 0) + "".join(block("p", some(3, long, r.choice(("related", "advert"))), 0) for _ in range(r.randint(1, 3)))
        return r.choice((f"<aside>{inner}</aside>", f"<aside{named('sidebar', 'side', 'right')}>{inner}</aside>", f"<div{named('sidebar', 'side', 'widget', 'secondary')}>{inner}</div>"))

    def comments() -> str:
        lines = ""
        tag = r.choice(("div", "div", "li", "article"))
        title = block(r.choice(("h2", "h3", "h4")), some(1, 3, "comment"), 0) if r.random() < 0.6 else ""
        for _ in range(r.randint(1, 5)):
            name = block("div", some(1, 2), 0, named("author", "user", "meta")) if r.random() < 0.3 else ""
            inner = name + block("p", some(2, r.choice((8, 40, 80)), "comment"), 0)
            lines += f"<{tag}{named('comment', 'reply', 'response', 'comment')}>{inner}</{tag}>"
        outer = r.choice(("div", "section", "ul")) if tag == "li" else r.choice(("div", "section"))
        return f"<{outer}{named('comments', 'discussion', 'replies', 'responses', 'disqus', 'comments')}>{title}{lines}</{outer}>"

    def article() -> str:
        parts = [block("h1", some(1, 9), 1)] if r.random() < 0.9 else []
        if r.random() < 0.1 and parts:
            parts.append(block("p", some(2, 5), 1))
        for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            text = some(1, r.choice((2, 8, 30, 60, 120))) + "."
            if r.random() < 0.2:
                text = f"<b>{text}" if r.random() < 0.5 else f'{text} <a href="/{word()}">{some(1, 3)}</a> <em>{some(1, 3)}</em>'
            if r.random() < 0.1:
                text += "<br>"
            if kind < 0.71:
                parts.append(block("p", text, 1, close=r.random() < 0.85))
            elif kind < 0.79:
                parts.append(block(r.choice(("h2", "h3")), some(1, 7), 1))
            elif kind < 0.85:
                parts.append("<ul>" + "".join(block("li", some(1, 20), 1) for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.89:
                parts.append(f"<blockquote>{block('p', text, 1)}</blockquote>")
            elif kind < 0.92:
                parts.append("<table><tr>" + "".join(block("td", some(1, 6), 1) for _ in range(r.randint(2, 4))) + "</tr></table>")
            elif kind < 0.97:
                parts.append(aside())
            else:
                parts.append(block("div", text, 1))
        if not parts or not any(labels):
            parts.append(block("p", some(1, 60) + ".", 1))
        if r.random() < 0.12:
            parts.append(comments())
        inner = "".join(parts)
        how = r.random()
        if how < 0.5:
            return f"<article{r.choice(('', '', named('post', 'entry', 'story')))}>{inner}</article>"
        if how < 0.65:
            return f"<main>{inner}</main>"
        return f"<{r.choice(('div', 'section'))}{named('content', 'post', 'entry', 'article', 'story', 'main', 'body', 'text', 'maincontent')}>{inner}</div>"

    out = f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    out += menu() if r.random() < 0.85 else ""
    out += "".join(aside() for _ in range(r.choice((0, 1, 1, 2))))
    wrap = r.random() < 0.3
    out += '<div class="container">' if wrap else ""
    out += article()
    out += "".join(aside() for _ in range(r.choice((0, 0, 1, 2))))
    out += comments() if r.random() < 0.35 else ""
    out += "</div>" if wrap else ""
    if r.random() < 0.85:
        inner = block("p", some(2, 15, "footer"), 0) if r.random() < 0.5 else None
        if inner is None:
            labels.append(0)
            inner = f"&copy; {word()}.example &middot; {some(1, 12, 'footer')}"
        out += r.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{named('footer', 'bottom', 'copyright', 'legal')}>{inner}</div>"))
    return out + "</body></html>", labels


@lru_cache(2)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Labeller:
    """The labeller, fitted to ``pages`` made pages."""
    r = random.Random(seed)
    data = []
    while len(data) < pages:
        html, labels = sample_page(r)
        found = blocks(html)
        if len(found) == len(labels):
            data.append((vectors(found), np.array(labels, np.float32)))
    return Labeller(seed).fit(data)


def extract(htmls: list[str | None], labeller: Labeller) -> list[str]:
    """The main text of each page."""
    found = [blocks(h) for h in htmls]
    return ["\n".join(b[1] for b, kept in zip(f, keep, strict=True) if kept) for f, keep in zip(found, labeller.label(found), strict=True)]


def main_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for rows (page_id, url, html)."""
    small_batches(pages.sparkSession)
    model = labeller or trained()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = extract(part.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(batches, "page_id long, url string, text string, n_chars long")


def op1_html_blocks(spark, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``pages``."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
