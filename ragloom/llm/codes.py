"""Operator 13: product codes of vectors, the nearest codebook entry found by annular norm pruning.

A vector is cut into equal parts, and each part is coded by the nearest entry of its own small codebook. Entries are
sorted by norm. By the triangle inequality an entry whose norm differs from a part's by more than the best distance so
far can't be nearer, so a binary search gives the interval of norms that may still win; both its ends belong to it, so that
ties are seen, and only what lies in that annulus is measured, exactly, in whole numbers.

Vectors become whole numbers first, floor(SCALE * x). Codebooks begin as the vectors of the least ids. In each round Spark
assigns all parts, sums them by entry within each task, then over tasks; what reaches the driver is one row for each
entry and component (PARTS * ENTRIES * components at most, whatever the table's size), and so are the codebooks that go
to the tasks.

Nulls: a null vector, and one with a null, infinite or undefined component, has no row; nor has one without components. A
null id's row is coded but no codebook begins with it; null labels are one label. Repeated rows are rows of their own, in
the beginning too, where ties of an id go by the vector. Ties of distance go to the lesser entry. Fewer vectors than
entries make a smaller codebook. Vectors of a length other than the first one's, or one that can't be cut into equal
parts, and components too large for whole-number distances are errors. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
STEP = 8  # entries on each side of a part's norm that are measured before the interval is looked up again


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has components, all of them finite."""
    return vectors.filter(F.size("vector") > 0).filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def whole(vectors: pa.Array, n: int, scale: int = SCALE) -> np.ndarray:
    """A list array of ``n`` vectors as rows of whole numbers, floor(scale * x)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = set(vectors.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths)}")
    scaled = np.floor(scale * flat)
    if len(scaled) and np.abs(scaled).max() >= 1 << 25:
        raise ValueError(f"a component is too large: at most {(1 << 25) // scale} can be coded in whole numbers")
    return scaled.astype(np.int64).reshape(n, -1)


class Annulus:
    """One part's codebook in order of norm."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]
        self.measured = 0

    def _key(self, points: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distance of points ``of`` to entries ``at``, with the entry's index for ties."""
        self.measured += len(of)
        d = points[of] - self.entries[at]
        return (d * d).sum(1) * len(self.order) + self.order[at]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the nearest entry's index, the lesser one of a tie, and its squared distance."""
        n, k = len(points), len(self.order)
        every = np.arange(n)
        if not n:
            return every, every
        norm = np.sqrt((points * points).sum(1).astype(np.float64))
        start = np.clip(np.searchsorted(self.norms, norm), 0, k - 1)
        end = start + 1
        best = self._key(points, every, start)
        while len(every):
            # the interval that the best distances allow, and the next entries of it on both sides of what was measured
            reach = np.sqrt((best[every] // k).astype(np.float64))
            reach += 1e-9 * (norm[every] + reach) + 1e-6  # roots are rounded; what is too wide costs a measurement only
            low = np.minimum(np.searchsorted(self.norms, norm[every] - reach, "left"), start)
            high = np.maximum(np.searchsorted(self.norms, norm[every] + reach, "right"), end)
            before, behind = np.maximum(low, start - STEP), np.minimum(high, end + STEP)
            for first, last in ((before, start), (end, behind)):
                count = last - first
                some = np.flatnonzero(count)
                if len(some):
                    count, of = count[some], every[some]
                    begin = np.cumsum(count) - count
                    at = np.arange(count.sum()) - np.repeat(begin - first[some], count)
                    best[of] = np.minimum(best[of], np.minimum.reduceat(self._key(points, np.repeat(of, count), at), begin))
            more = (before > low) | (behind < high)
            every, start, end = every[more], before[more], behind[more]
        return best % k, best // k


def _assigned(points: np.ndarray, books: list[Annulus]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row for each part) and squared distances, summed over parts."""
    cut = points.reshape(len(points), len(books), -1)
    found = [book.nearest(np.ascontiguousarray(cut[:, p])) for p, book in enumerate(books)]
    return np.array([f[0] for f in found]), sum(f[1] for f in found)


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """The parts of the vectors of the least ids: an array (part, entry, component); at most ``entries`` rows are fetched."""
    rows = vectors.filter("vec_id is not null").select("vec_id", "vector").orderBy("vec_id", "vector").limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    points = whole(pa.array([r.vector for r in rows], pa.list_(pa.float64())), len(rows), scale)
    if points.shape[1] % parts:
        raise ValueError(f"{points.shape[1]} components can't be cut into {parts} equal parts")
    return points.reshape(len(rows), parts, -1).swapaxes(0, 1)


def next_codebooks(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The codebooks after a round: each entry is the floored mean of the parts that are nearest to it, or stays."""
    parts, entries, size = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        searched = [Annulus(book) for book in books]
        for batch in batches:
            points = whole(batch.column(0), batch.num_rows, scale)
            slot = (_assigned(points, searched)[0] + np.arange(parts)[:, None] * entries).ravel()
            cut = points.reshape(batch.num_rows, parts, size).swapaxes(0, 1).reshape(-1, size)
            seen += np.bincount(slot, minlength=len(seen))
            np.add.at(total, slot, cut)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used * size, size) + np.tile(np.arange(size), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(seen[used], size))], ["slot", "total", "n"])

    added = vectors.select("vector").mapInArrow(sums, "slot long, total long, n long")
    # totals of many tasks may pass a long
    flat = books.reshape(-1).copy()
    for row in added.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        flat[row.slot] = int(row.total) // row.n
    return flat.reshape(books.shape)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks of all usable vectors (vec_id, vector) after some rounds."""
    small_batches(vectors.sparkSession)
    kept = usable(vectors)
    books = first_codebooks(kept, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = next_codebooks(kept, books, scale)
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The usable rows of ``vectors`` with code (a list of entries by part) and error (squared distance over all parts), without the vector."""
    small_batches(vectors.sparkSession)
    kept = usable(vectors)
    rest = [f for f in kept.schema.fields if f.name != "vector"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Annulus(book) for book in books]
        for batch in batches:
            codes, error = _assigned(whole(batch.column(len(rest)), batch.num_rows, scale), searched)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(books), pa.int32()), pa.array(codes.T.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], lists, pa.array(error, pa.int64())], [*(f.name for f in rest), "code", "error"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "code array<int>, error long"])
    return kept.select(*[F.col(f"`{f.name}`") for f in rest], "vector").mapInArrow(coded, fields)


def decode(code: list[int], books: np.ndarray, scale: int = SCALE) -> list[float]:
    """The vector that a code stands for."""
    return [x / scale for part, entry in enumerate(code) for x in books[part][entry].tolist()]


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """The contract's query: whole ``embeddings``, 16 parts, 64 entries, 2 rounds."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("vector"))
    books = fit(vectors)
    coded = checkpointed(encode(vectors, books))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label.withColumnRenamed("label", "same"), F.col("label").eqNullSafe(F.col("same")))
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return joined.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _round(book: str, name: str) -> str:
    """SQL of one round: parts with their nearest entry of ``book``, and the codebook ``name`` after it."""
    near = f"""near_{name} AS MATERIALIZED (SELECT row_no, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d, any_value(v) AS v
  FROM (SELECT p.row_no, p.part, p.v, c.entry, (p.v[1] - c.v[1]) ** 2 + (p.v[2] - c.v[2]) ** 2 + (p.v[3] - c.v[3]) ** 2 + (p.v[4] - c.v[4]) ** 2 AS d FROM parts p JOIN {book} c ON p.part = c.part) GROUP BY 1, 2)"""
    means = "[" + ", ".join(f"floor(sum(v[{k}]) / count(*))::BIGINT" for k in (1, 2, 3, 4)) + "]"
    return f"""{near},
{name} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (SELECT part, entry, {means} AS v FROM near_{name} GROUP BY 1, 2) m ON b.part = m.part AND b.entry = m.entry)"""


OP13_SQL = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row_no, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row_no, part, v[4 * part + 1 : 4 * part + 4] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
book0 AS MATERIALIZED (SELECT part, row_no AS entry, v FROM parts WHERE row_no < 64),
{_round("book0", "book1")},
{_round("book1", "book2")},
{_round("book2", "book3")},
coded AS (SELECT row_no, string_agg(lower(printf('%02x', entry::INT)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near_book3 GROUP BY 1),
told AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, 5)) AS place FROM book2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (row_no), told"""
