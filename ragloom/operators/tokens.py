"""Reading HTML as events, in one pass over the page, whatever bytes it has.

``Reader`` has the events of the standard library's parser (``handle_starttag``, ``handle_startendtag``, ``handle_endtag``,
``handle_data``), but takes time in proportion to the page and never fails: what isn't markup is text, and what begins like
markup and never ends is read as browsers do. Comments, declarations and processing instructions are left out; a section
like ``<![if x]>`` is a comment up to its ``>``. A tag without its ``>`` ends the page. The content of ``script`` and ``style`` is
raw up to its end tag, or to the page's end; that of ``title`` and ``textarea`` is text without tags, if it has an end tag.
"""

from __future__ import annotations

import re
from html import unescape

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SKIP, _WORD, _EQUALS, _BARE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
_RAW, _TEXT_ONLY = ("script", "style"), ("title", "textarea")
_RAW_END = {tag: re.compile(rf"(?i)</{tag}(?=[\s/>])") for tag in (*_RAW, *_TEXT_ONLY)}


def characters(text: str) -> str:
    """Text with its character references read; numbers beyond any character are the replacement character."""
    if "&" not in text:
        return text
    return unescape(_LONG_REFERENCE.sub("�", text))


class Reader:
    """Calls its handlers with the events of what ``feed`` is given; ``close`` ends the page. Made for whole pages: feed once."""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """A start tag; names are in small letters, of equal ones all are given."""

    def handle_endtag(self, tag: str) -> None:
        """An end tag."""

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """A start tag that ends itself."""
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        """Text between tags, comments or the page's ends."""

    def feed(self, page: str) -> None:
        """Read a page."""
        self._missing: set[str] = set()
        self._pending: list[str] = []
        at, n = 0, len(page)
        while at < n:
            start = page.find("<", at)
            if start < 0:
                self._text(page[at:])
                break
            self._text(page[at:start])
            at = self._markup(page, start)
        self._told()

    def close(self) -> None:
        """The page's end."""

    def _text(self, text: str) -> None:
        if text:
            self._pending.append(text)

    def _told(self) -> None:
        if self._pending:
            data, self._pending = characters("".join(self._pending)), []
            self.handle_data(data)

    def _markup(self, page: str, start: int) -> int:
        """Read what begins with the ``<`` at ``start``; where to go on."""
        second = page[start + 1 : start + 2]
        if second == "!" or second == "?":
            self._told()
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)  # <!--> and <!---> are whole comments
                return end + 3 if end >= 0 else len(page)
            end = page.find(">", start)
            return end + 1 if end >= 0 else len(page)
        if second == "/":
            name = _NAME.match(page, start + 2)
            self._told()
            if not name:  # </> is nothing, others are comments
                end = page.find(">", start)
                return end + 1 if end >= 0 else len(page)
            end = self._attributes(page, name.end())
            if end:
                self.handle_endtag(name[0].lower())
            return end[0] if end else len(page)
        name = _NAME.match(page, start + 1)
        if not name:
            self._text("<")
            return start + 1
        self._told()
        end = self._attributes(page, name.end())
        if not end:
            return len(page)
        at, closed, attrs = end
        tag = name[0].lower()
        if closed:
            self.handle_startendtag(tag, attrs)
            return at
        self.handle_starttag(tag, attrs)
        return self._raw(page, at, tag) if tag in _RAW_END else at

    def _raw(self, page: str, at: int, tag: str) -> int:
        """Read the content of an element that has no elements within it."""
        found = None if tag in self._missing else _RAW_END[tag].search(page, at)
        if not found:
            self._missing.add(tag)  # nor will there be one for a later element
            if tag in _TEXT_ONLY:
                return at
        end = found.start() if found else len(page)
        if end > at:
            self.handle_data(page[at:end] if tag in _RAW else characters(page[at:end]))
        return end

    def _attributes(self, page: str, at: int) -> tuple[int, bool, list[tuple[str, str | None]]] | None:
        """The end of a tag whose attributes begin at ``at``, whether it ends itself, and its attributes; None without an end."""
        attrs, n = [], len(page)
        while True:
            here = _SKIP.match(page, at).end()
            if here >= n:
                return None
            if page[here] == ">":
                return here + 1, here > at and page[here - 1] == "/", attrs
            word = _WORD.match(page, here)
            at, value = word.end(), None
            equals = _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                if quote == '"' or quote == "'":
                    end = page.find(quote, at + 1)
                    if end < 0:
                        return None
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            attrs.append((word[0].lower(), None if value is None else characters(value)))
