"""Operator 11: periodic runs in texts, by Main and Lorentz's divide and conquer on interned words.

A text's words are interned as small numbers. A run of smallest period q is a maximal stretch whose words q apart are
equal, at least LEAST_EXPONENT periods and LEAST_WORDS words long. A run crosses the midpoint of exactly one block that
holds all of it, and of that block's halves the Z-functions tell, for every period at once, how far words agree with
those q before or behind them: forwards and backwards from the midpoint. What reaches past its block belongs to a run that
a larger block has found already, so extending it by one word is enough to tell; intervals that are found with several
periods keep the least. Blocks deep inside a run repeat what lies in its first periods, which is copied instead.

Divide and conquer is only needed where a run may lie. Each window of GRAM words inside a run has an equal one elsewhere
in the run, so stretches of windows that occur once in a text are left out beforehand. That drops no run.

Nulls: a null text has no words and so no runs; a null id keeps its row, and its text is as it is. Repeated rows are rows of
their own. Ties: of runs of one length the first is the longest, then that of the lesser period. Texts without words, and
texts too short for a run, have none; very long texts take time n * log(n) in one row. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, small_batches, words

LEAST_EXPONENT, LEAST_WORDS, GRAM = 4, 6, 5
RUN = "array<struct<start:long,length:long,period:long>>"


def z_function(s: np.ndarray) -> np.ndarray:
    """For each place, how many words from there equal the first ones. Only places of the first word can have any."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    z, listed = [0] * n, s.tolist()
    z[0] = n
    left = right = 0
    for i in np.flatnonzero(s == s[0])[1:].tolist():
        k = 1
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        near = min(n, i + k + 8)
        while i + k < near and listed[k] == listed[i + k]:
            k += 1
        step = 16
        while near <= i + k < n:  # compare ever longer stretches, so that a long match costs few calls
            end = min(n, i + k + step)
            same = s[k : end - i] == s[i + k : end]
            if not same.all():
                k += int(same.argmin())
                break
            k, step = end - i, 2 * step
        z[i], left, right = k, i, i + k
    return np.array(z, np.int64)


def _behind(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place of ``b``, how many words from there equal the first ones of ``a``."""
    return z_function(np.concatenate([a, [-1], b]))[len(a) + 1 :]


def crossing(s: np.ndarray, mid: int, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """Repetitions (start, end, period) of ``s`` that cross ``mid``, maximal within ``s``; a period may not be the least one."""
    u, v = s[:mid], s[mid:]
    found = []
    back, front = u[::-1], v[::-1]
    ahead, behind = z_function(v), z_function(back)
    # words from mid on, and those q further on: they agree from mid on, and from mid back. Back in v that is at most q words; then both are in u
    q = np.arange(1, min(len(s) // exponent, len(v)) + 1)
    if len(q):
        on = np.append(ahead, 0)[q]
        before = _behind(back, front)[len(v) - q]
        before += np.where(before == q, np.append(behind, np.zeros(max(1, len(v)), np.int64))[q], 0)
        ok = on + before >= np.maximum((exponent - 1) * q, least - q)
        found += zip((mid - before)[ok].tolist(), (mid + on + q)[ok].tolist(), q[ok].tolist())
    # words before mid, and those q further back; what agrees for q words and more from mid on was found above
    q = np.arange(1, min(len(s) // exponent, len(u)) + 1)
    if len(q):
        before = np.append(behind, 0)[q]
        on = _behind(v, u)[len(u) - q]
        ok = (on + before >= np.maximum((exponent - 1) * q, least - q)) & (on < q)
        found += zip((mid - before - q)[ok].tolist(), (mid + on)[ok].tolist(), q[ok].tolist())
    return found


def stretches(s: np.ndarray, gram: int = GRAM) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) outside of which no run lies: of windows of ``gram`` words that occur more than once."""
    n = len(s) - gram + 1
    if n < 2:
        return
    mixed = s.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):  # equal windows have equal keys; a chance collision only keeps more
            key = (key ^ (mixed[k : k + n] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    same = sorted_[1:] == sorted_[:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    yield from ((start, end + gram - 1) for start, end in edges.reshape(-1, 2).tolist())


def find_runs(s: np.ndarray, exponent: int = LEAST_EXPONENT, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the numbers ``s`` by start, then period. The exponent is at least 2."""
    best: dict[tuple[int, int], int] = {}
    inside: list[tuple[int, int, int]] = []  # long runs, which repeat the runs in their first periods
    gram = min(GRAM, least - 1) if exponent >= 4 else 1  # so that an equal window lies in the run, too
    for first, last in stretches(s, gram):
        todo: list[tuple[int, int, tuple]] = [(first, last, ())]
        while todo:
            lo, hi, around = todo.pop()
            if hi - lo < least or any(a + 3 * q + 1 < lo and hi < b - 2 * q - 1 for a, b, q in around):
                continue
            mid = (lo + hi) // 2
            here: dict[tuple[int, int], int] = {}
            for start, end, q in crossing(s[lo:hi], mid - lo, exponent, least):
                start, end = start + lo, end + lo
                longer = (start == lo > 0 and s[lo - 1] == s[lo - 1 + q]) or (end == hi < len(s) and s[hi] == s[hi - q])
                if not longer and q < here.get((start, end), q + 1):
                    here[start, end] = q
            best |= here
            long = tuple((a, b, q) for (a, b), q in here.items() if b - a > 6 * q)
            inside += long
            todo += [(lo, mid, around + long), (mid, hi, around + long)]
    # a run within a run of period q is shorter than both periods, so each has a copy that begins in the first q words
    order = sorted(best)
    for a, b, q in sorted(inside, key=lambda r: r[2]):
        for start, end in order[bisect_left(order, (a + 1,)) : bisect_left(order, (a + q + 1,))]:
            if (p := best[start, end]) < q and end < b:
                for k in range(q, b - end, q):
                    if best.setdefault((start + k, end + k), p) == p and order[bisect_left(order, (start + k, end + k)) % len(order)] != (start + k, end + k):
                        insort(order, (start + k, end + k))
    return sorted((start, end - start, q) for (start, end), q in best.items())


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run has behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def text_runs(text: str | None, exponent: int = LEAST_EXPONENT, least: int = LEAST_WORDS) -> tuple[int, list[tuple[int, int, int]], str]:
    """A text's number of words, its runs, and its words without what the runs repeat, joined by one space."""
    listed = (text or "").encode().split()  # bytes: only ASCII spaces split
    ids: dict[bytes, int] = {}
    s = np.fromiter((ids.setdefault(w, len(ids)) for w in listed), np.int64, len(listed))
    runs = find_runs(s, exponent, least)
    kept = [listed[i] for i in np.flatnonzero(collapse(len(s), runs)).tolist()] if runs else listed
    return len(s), runs, b" ".join(kept).decode()


def periodic_runs(docs: DataFrame, exponent: int = LEAST_EXPONENT, least: int = LEAST_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed) of docs (doc_id, text): runs in order, and the text without their repeats."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [text_runs(text.as_py(), exponent, least) for text in part.column(1)]
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in f[1]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.int64()), runs, pa.array([f[2] for f in found], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts (doc_id, text): of a tenth of the ids, the words from a place on repeat with a period."""
    h = crc32_text(F.col("doc_id").cast("string"))
    listed = F.when(h % 10 == 0, words(F.col("text")))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), listed.alias("listed")).withColumn("n", F.size("listed"))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))

    def word(i: Column) -> Column:
        return F.get("listed", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))

    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    return period.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The contract's query: whole ``documents`` with planted periods, runs of four periods and six words at least."""
    found = periodic_runs(with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # of the greatest length the first one, then the least period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.array_join(lines, "").alias("told"), "collapsed")
    start, length, period = -F.col("best.s"), F.col("best.length"), -F.col("best.p")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return told.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), digest("told").alias("runs_sha256"), digest("collapsed").alias("collapsed_sha256"))
