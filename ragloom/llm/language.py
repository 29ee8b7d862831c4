"""Operator 5: language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (one to three letters, words padded with a blank) in
order of frequency. A document's own most frequent n-grams are compared with each profile: an n-gram costs the
difference of its two ranks, or the profile's length if the profile lacks it. The language of the least sum wins.

Nulls: a null text, or one without a letter, is ``und`` with score 0; documents with a null lang aren't learned
from. Ties between languages go to the first by name, between n-grams to the lesser code. Repeated rows are
predicted alike. Very long texts are counted in parts. Without anything to learn from all are ``und``. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: n-grams of a profile and of a document; documents learned from for each language, about.
PROFILE, TRAIN_ROWS = 400, 1500
BLANK, CHUNK = 0x110000, 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(BLANK)] + [False])


def _keys(points: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of code points, of which all but letters are BLANK."""
    a, b = points[:-1], points[1:]
    two = (a << 21 | b)[(a != BLANK) | (b != BLANK)]
    three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[points[1:-1] != BLANK]
    return np.concatenate([b[b != BLANK], two, three])


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and their counts."""
    if counts is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[starts], np.diff(np.r_[starts, len(keys)])
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as codes, and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4").astype(np.int64)
    points[~_letters()[points]] = BLANK
    parts = []
    for at in range(0, len(points), CHUNK):
        # parts share two code points; what lies within the shared ones belongs to the part before
        part = points[max(0, at - 2) : at + CHUNK]
        if at == 0:
            part = np.r_[BLANK, part]
        if at + CHUNK >= len(points):
            part = np.r_[part, BLANK]
        keys = _keys(part)
        if at:
            keys = np.concatenate([part[2:][part[2:] != BLANK], keys[len(part[1:][part[1:] != BLANK]) :]])
            twice = part[0] << 21 | part[1]
            if part[0] != BLANK or part[1] != BLANK:
                keys = np.delete(keys, np.flatnonzero(keys == twice)[0])
        parts.append(_counted(keys))
    if len(parts) == 1:
        return parts[0]
    return _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def top(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order."""
    if len(counts) and counts.max() < 1 << 16:
        return keys[np.argsort((65535 - counts).astype(np.uint16), kind="stable")[:size]]
    return keys[np.argsort(-counts, kind="stable")[:size]]


def held_out(doc_id="doc_id"):
    """Whether a document must not be learned from: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def profiles(docs: DataFrame, train_rows: int = TRAIN_ROWS, size: int = PROFILE) -> dict[str, list[int]]:
    """Language to n-gram codes by rank, learned from about ``train_rows`` documents of each language, chosen by hash."""
    small_batches(docs.sparkSession)
    known = docs.filter("lang is not null and doc_id is not null").filter(~held_out()).select("doc_id", "text", "lang")
    # one row for each language
    share = known.groupBy(F.col("lang").alias("l")).agg((F.least(F.lit(1.0), train_rows / F.count("*")) * (1 << 30)).cast("long").alias("share"))
    chosen = known.join(F.broadcast(share), F.col("lang") == F.col("l")).filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < F.col("share"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found.setdefault(lang, []).append(ngrams(text))
            for lang, each in found.items():
                keys, n = _counted(np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    # ``size`` rows for each language: what is sent to the tasks grows with the languages, never with the documents
    out: dict[str, list] = {}
    for lang, gram, _, rank in ranked.collect():
        out.setdefault(lang, []).append((rank, gram))
    return {lang: [g for _, g in sorted(out[lang])] for lang in sorted(out)}


class RankOrder:
    """Out-of-place distances to all profiles at once, by an index from n-grams to the profiles that have them."""

    def __init__(self, learned: dict[str, list[int]], size: int = PROFILE) -> None:
        self.langs, self.size = list(learned), size
        grams = np.array([g for p in learned.values() for g in p], np.int64)
        order = np.argsort(grams, kind="stable")
        self.lang = np.repeat(np.arange(len(learned)), [len(p) for p in learned.values()])[order]
        self.rank = np.concatenate([np.arange(len(p)) for p in learned.values()] or [np.zeros(0, np.int64)])[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.end = np.r_[self.first[1:], len(grams)]

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = ngrams(text)
        if not len(keys) or not self.langs:
            return "und", 0.0
        mine = top(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == mine)
        n = self.end[at[place]] - self.first[at[place]]
        # the entries of each n-gram that is in some profile, and its place in the document
        entry = np.arange(n.sum()) + np.repeat(self.first[at[place]] - np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else np.zeros(0, np.int64)
        nearer = self.size - np.abs(self.rank[entry] - np.repeat(place, n))
        places = self.size * len(mine) - np.bincount(self.lang[entry], nearer, len(self.langs)).astype(np.int64)
        best = int(places.argmin())
        return self.langs[best], float(1 - places[best] / (self.size * len(mine)))


def identify(docs: DataFrame, learned: dict[str, list[int]]) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score)."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RankOrder(learned)
        for part in parts:
            found = [model.predict(text) for text in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, profiles(docs))
