"""Operator 4: licence scans by template-markup matching.

A template is a licence's standard wording with markup: ``<<`` ... ``>>`` holds what may be left out, ``[[n]]``
stands for up to n words of any kind (names, years, places), ``{a|b}`` for one of several words. Templates are
compiled to automata over words; a place matches if all mandatory words follow in order, with nothing else
between but what the markup allows. Case, punctuation and line breaks don't count.

Nulls: a null text counts as empty: no words, no label, score 0. Ties: of matches that begin at one place the longest
counts, and each template has its own place. Repeated rows are scanned alike. Very long texts are scanned whole; an
automaton is tried only on texts that have all of its longest mandatory words, and started only at its first words. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words of the contract: runs of digits, letters a-z and bytes from 0x80, after lower-casing A-Z.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Fixed phrases of the contract, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Fixed wording that the BSD licences of two and of three clauses share.
BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

#: Fixed standard wordings of public licences: (label, weight, template). The weight is the score of a match.
TEMPLATES = (
    ("mit-notice", 0.8, "{released|licensed|distributed|available|provided} under <<the terms of>> the mit license"),
    ("apache-2.0-notice", 0.8, "licensed under the apache license version 2 0 <<the license>>"),
    ("gpl-notice", 0.8, "{licensed|released|distributed} under <<the terms of>> the <<gnu>> general public license version {1|2|3} <<0>> <<or <<at your option>> any later version>>"),
    ("cc-by-notice", 0.8, "{licensed|released|available} under <<a>> <<the>> cc by {1|2|3|4} 0"),
    ("cc-by-nc-notice", 0.8, "{licensed|released|available} under <<a>> <<the>> cc by nc {1|2|3|4} 0"),
    ("cc-by-sa-notice", 0.8, "{licensed|released|available} under <<a>> <<the>> cc by sa {1|2|3|4} 0"),
    ("mpl-2.0-notice", 0.8, "subject to the terms of the mozilla public license <<version>> <<v>> 2 0"),
    ("lgpl-notice", 0.8, "{licensed|released|distributed} under <<the terms of>> the <<gnu>> {lesser|library} general public license <<version>> <<v>> <<{2|2.1|3}>>"),
    ("agpl-notice", 0.8, "{licensed|released|distributed} under <<the terms of>> the <<gnu>> affero general public license <<version>> <<v>> <<3>>"),
    ("gpl-title", 0.9, "gnu general public license version {1|2|3} {june|july|february} <<[[1]]>> {1989|1991|2007}"),
    ("apache-2.0-title", 0.9, "apache license version 2 0 january 2004"),
    ("cc0-text", 1.0, "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide"),
    ("unlicense-text", 1.0, "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("spdx", 0.9, "spdx license identifier [[4]]"),
    (
        "mit-text",
        1.0,
        "permission is hereby granted free of charge to any person obtaining a copy of this software and <<[[2]]>> associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<including the next paragraph>> shall be included in all copies or substantial portions of the software <<the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall [[12]] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software>>",
    ),
    (
        "isc-text",
        1.0,
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "apache-2.0-header",
        1.0,
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[8]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-header",
        1.0,
        "this {program|software|library|file} is free software <<you can redistribute it>> <<and or modify it>> under the terms of the gnu <<{lesser|affero|library}>> general public license as published by the free software foundation either version {1|2|3} <<{0|1}>> of the license or at your option any later version",
    ),
    ("bsd-text", 1.0, BSD),
    ("bsd-3-clause-text", 1.0, BSD + " <<3>> neither the name of [[12]] nor the names of [[4]] contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
)

_TOKEN = re.compile(r"<<|>>|\[\[\d+\]\]|\{[^}]*\}|[^\s<>{}\[\]]+")
ANY = None


def _mandatory(tokens: list[str]) -> Iterator[bytes]:
    """The words outside of regions that may be left out or replaced."""
    depth = 0
    for token in tokens:
        depth += (token == "<<") - (token == ">>")
        if not depth and token != ">>" and token[0] not in "[{":
            yield token.encode()


class Automaton:
    """States with steps: (set of words or ANY for any word, next state); a free step goes on without a word."""

    def __init__(self, template: str) -> None:
        self.steps: list[list[tuple[frozenset | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self._tokens, self._at = _TOKEN.findall(template), 0
        #: The longest words that every match has: a text without one of them has no match.
        self.needed = tuple(sorted(set(_mandatory(self._tokens)), key=lambda w: (-len(w), w))[:4])
        self.accept = self._sequence(0)
        self.closed = [self._closure(s) for s in range(len(self.steps))]
        #: The words that a match may start with; None if any.
        first = [w for s in self.closed[0] for w, _ in self.steps[s]]
        self.first = None if ANY in first else frozenset().union(*first)

    def _new(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _sequence(self, state: int) -> int:
        """Reads up to the end of the template or of a region; returns the last state."""
        while self._at < len(self._tokens):
            token = self._tokens[self._at]
            self._at += 1
            if token == ">>":
                break
            if token == "<<":
                inner = self._new()
                self.free[state].append(inner)
                last = self._sequence(inner)
                after = self._new()
                self.free[last].append(after)
                self.free[state].append(after)
                state = after
            elif token.startswith("[["):
                after = self._new()
                for _ in range(int(token[2:-2])):
                    self.free[state].append(after)
                    there = self._new()
                    self.steps[state].append((ANY, there))
                    state = there
                self.free[state].append(after)
                state = after
            else:
                after = self._new()
                self.steps[state].append((frozenset(w.encode() for w in token.strip("{}").split("|")), after))
                state = after
        return state

    def _closure(self, state: int) -> frozenset[int]:
        found, left = {state}, [state]
        while left:
            for s in self.free[left.pop()]:
                if s not in found:
                    found.add(s)
                    left.append(s)
        return frozenset(found)

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest match at ``start``, or None."""
        now, end = self.closed[0], None
        for k in range(start, len(words) + 1):
            if self.accept in now:
                end = k
            if k == len(words):
                break
            now = frozenset().union(*(self.closed[to] for s in now for on, to in self.steps[s] if on is ANY or words[k] in on))
            if not now:
                break
        return end


def compiled(templates=TEMPLATES) -> list[tuple[str, float, Automaton]]:
    """Label, weight, automaton. A template must begin with a mandatory word, so that few places start one."""
    out = [(label, weight, Automaton(template)) for label, weight, template in templates]
    if any(a.first is None for *_, a in out):
        raise ValueError("a template must not begin with a replaceable region")
    return out


def scan_text(text: str | None, automata: list[tuple[str, float, Automaton]]) -> dict:
    """The contract's values for one text, and ``places``: (label, first word, end) of the method's matches."""
    low = (text or "").encode().lower()
    words = WORD.findall(low)
    n_base, first, last, labels, places, score = 0, None, None, set(), [], 0.0
    if b"license" in low:
        for k, w in enumerate(words):
            if w == b"license":
                for phrase, label in _PHRASES:
                    start = k - len(phrase) + 1
                    if start >= 0 and words[start : k + 1] == phrase:
                        n_base += 1
                        first = start if first is None else min(first, start)
                        last = start if last is None else max(last, start)
                        labels.add(label)
                        score = max(score, 0.5)
    base = sorted(labels)
    some = [a for a in automata if all(w in low for w in a[2].needed)]
    if some:
        starts: dict[bytes, list] = {}
        for a in some:
            for w in a[2].first:
                starts.setdefault(w, []).append(a)
        for k, w in enumerate(words):
            for label, weight, automaton in starts.get(w, ()):
                if (end := automaton.match(words, k)) is not None:
                    labels.add(label)
                    places.append((label, k, end))
                    score = max(score, weight)
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(base), "labels": ",".join(sorted(labels)), "score": score, "places": places}


_PHRASES = [(phrase.encode().split(), label) for phrase, label in BASE]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Rows with the contract's columns and ``places`` for rows (doc_id, text)."""
    small_batches(docs.sparkSession)
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        for part in parts:
            found = [scan_text(text, automata) for text in part.column(1).to_pylist()]
            columns = [pa.array([f[c] for f in found], kind) for c, kind in kinds.items()]
            places = pa.array([",".join(f"{label}:{start}:{end}" for label, start, end in f["places"]) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, places], ["doc_id", *kinds, "places"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``; ``places`` lists the method's matches as label:start:end."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
