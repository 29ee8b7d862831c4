"""Exact vector search: normalisation (V3), cosine (V6), fusion of several query forms (V7), quotas (V8, V9).

Every stage is a window over one query's rows, so many queries are answered at once. What the stages can pick is
bounded by rank limits (``Limit``): the best rows of a pool, at most so many of a document. ``best_scores`` keeps to them
while it scores: each task holds the rows of each query that are within a limit so far, and whatever scores below the
last of them is let go at once, so that a task sends a few rows for each query instead of one for each chunk. Scores
are summed in the order of components, as ``dot`` does, so that equal vectors tie.

Queries are broadcast up to a number of bytes; more are searched in blocks, each against all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.sinks import checkpointed, small_batches

#: Bytes of queries that may be broadcast; more are joined in blocks of about so many, each with blocks of chunks.
MOST_BYTES = 64 << 20
#: Queries that are scored together.
GROUP = 128
#: Rows that a group gathers at least before it sorts them.
LEAST_NEW = 4096
#: A group holds what rows must reach of each document for at most so many documents.
MOST_DOCS = 1024


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """V3: the vector over its length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def _blocks(chunks: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """All pairs without a broadcast: blocks of queries go to all blocks of chunks and the other way round."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    among = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = chunks.withColumns({"chunk_block": some("chunk_id", parts), "query_block": among(blocks)})
    right = queries.withColumns({"query_block": some("query_id", blocks), "chunk_block": among(parts)})
    return left.join(right.hint("merge"), ["query_block", "chunk_block"]).drop("query_block", "chunk_block")


def fused_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """V6, V7: each query with each chunk that isn't excluded for it.

    chunks: chunk_id, doc, doc_type, vector. queries: query_id, original, translated (vectors), exclude (chunk ids).
    Adds score_original, and score: the greater of both forms' inner products.
    """
    bytes_ = queries.agg(F.sum(8 * (F.size("original") + F.size("translated") + F.size("exclude")) + 64)).first()[0] or 0
    pairs = (chunks.crossJoin(F.broadcast(queries)) if bytes_ <= MOST_BYTES else _blocks(chunks, queries, -(-bytes_ // MOST_BYTES))).filter(~F.array_contains("exclude", F.col("chunk_id")))
    scored = pairs.withColumn("score_original", dot(F.col("vector"), F.col("original"))).withColumn("translated_score", dot(F.col("vector"), F.col("translated")))
    return scored.select("query_id", "chunk_id", "doc", "doc_type", "score_original", F.greatest("score_original", "translated_score").alias("score"))


@dataclass(frozen=True)
class Limit:
    """The ``most`` best rows by a score, of a document type or of all, of the ``per_doc`` best ones of each document."""

    by: str
    most: int
    doc_type: str | None = None
    per_doc: int | None = None


class _Best:
    """Of some queries the rows that are within a limit, of all chunks so far. Rows are numbers: of the query, and codes of document and type."""

    def __init__(self, first: int, original: np.ndarray, translated: np.ndarray, limits: list[Limit]) -> None:
        self.first, self.count, self.limits = first, len(original), limits
        self.forms = (original, translated)
        self.sides = np.concatenate([original, translated]).T.copy()
        # how far a product of matrices may lie from the sum by components, for a vector of length 1
        self.slack = 4e-16 * (original.shape[1] + 8) * np.sqrt((self.sides**2).sum(0))
        self.least = [np.full(self.count, -np.inf) for _ in limits]  # what a row of the limit's pool must reach
        self.of_doc: list[tuple | None] = [None] * len(limits)  # and what it must of its document, while pools aren't full
        self.rows: list[dict] = []
        self.held = self.new = 0

    def _must(self, k: int, doc: np.ndarray, query: np.ndarray | slice) -> np.ndarray:
        """What rows of these documents must reach for a limit and queries."""
        if self.of_doc[k] is None:
            return self.least[k][query]
        docs, table = self.of_doc[k]
        at = np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
        return np.maximum(self.least[k][query], table[np.where(docs[at] == doc, at, len(docs)), query])

    def add(self, points: np.ndarray, norms: np.ndarray, batch: dict[str, np.ndarray], kinds: list[tuple[slice, list[bool]]], exclude: tuple[np.ndarray, np.ndarray]) -> None:
        """A batch's chunks, those of one document type side by side: ``kinds`` has each type's rows and which limits are for it.

        A product of matrices tells which pairs can be within a limit; only those are summed as ``dot`` does.
        """
        may = np.zeros((len(points), self.count), bool)
        with np.errstate(invalid="ignore", over="ignore"):
            close = points @ self.sides
            for rows, for_it in kinds:
                least = {"score": np.inf, "score_original": np.inf}
                for k, limit in enumerate(self.limits):
                    if for_it[k]:
                        least[limit.by] = np.minimum(least[limit.by], self._must(k, batch["doc"][rows], slice(None)))
                room = norms[rows, None] * self.slack
                either = np.minimum(least["score"], least["score_original"])
                may[rows] = ~((close[rows, : self.count] < either - room[:, : self.count]) & (close[rows, self.count :] < least["score"] - room[:, self.count :]))
            may[~batch["regular"]] |= any(np.isneginf(x).any() for x in self.least)
            mine = (exclude[1] >= self.first) & (exclude[1] < self.first + self.count)
            may[exclude[0][mine], exclude[1][mine] - self.first] = False
            chunk, query = np.nonzero(may)
            first, second = (_dots(points, chunk, form, query) for form in self.forms)
            odd = ~batch["regular"][chunk]
            first[odd], second[odd] = -np.inf, -np.inf
            scores = {"score_original": first, "score": np.maximum(first, second)}
            inside = np.zeros(len(chunk), bool)
            for k, limit in enumerate(self.limits):
                pool = np.array([for_it[k] for _, for_it in kinds], bool)[batch["kind"][chunk]]
                inside |= pool & ~(scores[limit.by] < self._must(k, batch["doc"][chunk], query))
        if inside.any():
            chunk, query = chunk[inside], query[inside]
            self.rows.append({"query": query} | {k: v[inside] for k, v in scores.items()} | {k: v[chunk] for k, v in batch.items()} | {"pools": np.array([for_it for _, for_it in kinds], bool)[batch["kind"][chunk]]})
            self.new += len(chunk)
            # a row is sorted a few times only: when as many have come as are held
            if self.new > max(self.held, LEAST_NEW):
                self.prune()

    def prune(self) -> None:
        """Let go what is within no limit."""
        if not self.new:
            return
        rows = {k: np.concatenate([r[k] for r in self.rows]) for k in self.rows[0]}
        _, order = np.unique(rows["chunk_id"], return_inverse=True)
        keep = np.zeros(len(order), bool)
        for k, limit in enumerate(self.limits):
            pool = np.flatnonzero(rows["pools"][:, k])
            value = np.where(np.isnan(rows[limit.by]), np.inf, rows[limit.by])
            if limit.per_doc:
                pool = _first(pool, [rows["query"], rows["doc"]], value, order, limit.per_doc)
            pool = _first(pool, [rows["query"]], value, order, limit.most)
            keep[pool] = True
            held, last = np.bincount(rows["query"][pool], minlength=self.count), np.full(self.count, np.inf)
            np.minimum.at(last, rows["query"][pool], value[pool])
            self.least[k], self.of_doc[k] = np.where(held >= limit.most, last, -np.inf), None
            docs, at = np.unique(rows["doc"][pool], return_inverse=True)
            if limit.per_doc and (held < limit.most).any() and 0 < len(docs) <= MOST_DOCS:
                place = at * self.count + rows["query"][pool]
                each, last = np.bincount(place, minlength=len(docs) * self.count), np.full(len(docs) * self.count, np.inf)
                np.minimum.at(last, place, value[pool])
                table = np.where(each >= limit.per_doc, last, -np.inf).reshape(len(docs), self.count)
                self.of_doc[k] = docs, np.concatenate([table, np.full((1, self.count), -np.inf)])
        self.rows, self.held, self.new = [{k: v[keep] for k, v in rows.items()}], int(keep.sum()), 0


class _Codes(dict):
    """Numbers for values as they come."""

    def __missing__(self, value: str | None) -> int:
        out = self[value] = len(self)
        return out


def _first(rows: np.ndarray, keys: list[np.ndarray], value: np.ndarray, ties: np.ndarray, most: int) -> np.ndarray:
    """Of ``rows`` the ``most`` first of each key, by value downwards, then by ``ties``."""
    rows = rows[np.lexsort([ties[rows], -value[rows], *(k[rows] for k in reversed(keys))])]
    if not len(rows):
        return rows
    new = np.any([np.diff(k[rows], prepend=k[rows[0]] - 1) != 0 for k in keys], 0)
    starts = np.flatnonzero(new)
    return rows[np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) < most]


def _dots(a: np.ndarray, left: np.ndarray, b: np.ndarray, right: np.ndarray, run: int = 8192) -> np.ndarray:
    """The inner products of rows ``left`` of ``a`` with rows ``right`` of ``b``, each summed component by component."""
    out = np.zeros(len(left))
    for k in range(0, len(left), run):
        for x, y in zip(np.ascontiguousarray(a[left[k : k + run]].T), np.ascontiguousarray(b[right[k : k + run]].T)):
            out[k : k + run] += x * y
    return out


def best_scores(chunks: DataFrame, queries: DataFrame, limits: list[Limit]) -> DataFrame:
    """V6, V7: the rows of ``fused_scores`` that may be within one of ``limits``: those that are so in their task.

    Queries of more than MOST_BYTES, and queries whose vectors have several lengths or nulls, go through ``fused_scores``.
    A chunk whose vector is null, has nulls or another length has null scores, which come last. Many queries are dealt over
    tasks in blocks, each of which meets all chunks or a part of them, so that what tasks send doesn't grow with their
    number. The rows are checkpointed, as each limit reads them.
    """
    spark = chunks.sparkSession
    shape = queries.agg(F.sum(8 * (F.size("original") + F.size("translated") + F.size("exclude")) + 64).alias("bytes"), F.min(F.least(F.size("original"), F.size("translated"))).alias("low"), F.max(F.greatest(F.size("original"), F.size("translated"))).alias("high"), F.count_if(F.col("original").isNull() | F.col("translated").isNull() | F.exists("original", lambda x: x.isNull()) | F.exists("translated", lambda x: x.isNull())).alias("odd")).first()
    if not shape.bytes or shape.bytes > MOST_BYTES or shape.low != shape.high or shape.odd:
        return fused_scores(chunks, queries)
    small_batches(spark)
    asked = queries.select("query_id", "original", "translated", "exclude").toArrow()
    size, total = shape.low, len(asked)
    matrix = lambda c: asked[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    excluded: dict = {}
    for q, some in enumerate(asked["exclude"].to_pylist()):
        for c in some or ():
            excluded.setdefault(c, []).append(q)
    held = spark.sparkContext.broadcast((matrix("original"), matrix("translated"), excluded, asked["query_id"].combine_chunks()))
    names = {c: to_arrow_type(chunks.schema[c].dataType) for c in ("chunk_id", "doc", "doc_type")}
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = min(tasks, total // (2 * GROUP))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        original, translated, excluded, ids = held.value
        groups: dict[int, list[_Best]] = {}
        docs, types = _Codes(), _Codes()
        for whole in batches:
            for block in set(whole.column(4).to_pylist()):
                batch = whole.filter(pa.array(whole.column(4).to_numpy() == block))
                if block not in groups:
                    own = range(block * total // max(1, blocks), (block + 1) * total // max(1, blocks) if blocks > 1 else total)
                    groups[block] = [_Best(k, original[k : min(k + GROUP, own.stop)], translated[k : min(k + GROUP, own.stop)], limits) for k in range(own.start, own.stop, GROUP)]
                kind = np.array([types[x] for x in batch.column(2).to_pylist()])
                order = np.argsort(kind, kind="stable")
                batch, kind = batch.take(pa.array(order)), kind[order]
                vectors = batch.column(3)
                good = np.array([n == size for n in vectors.value_lengths().to_pylist()], bool)
                flat = vectors.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                points, regular = np.zeros((len(good), size)), good.copy()
                points[good] = flat
                if vectors.flatten().null_count:
                    regular &= np.array([v is not None and None not in v for v in vectors.to_pylist()], bool)
                found = batch.column(0).to_pylist()
                pairs = [(row, q) for row, c in enumerate(found) for q in excluded.get(c, ())]
                columns = {"chunk_id": batch.column(0).to_numpy(zero_copy_only=False), "doc": np.array([docs[x] for x in batch.column(1).to_pylist()]), "kind": kind, "regular": regular}
                told = list(types)
                ends = np.searchsorted(kind, np.arange(len(told) + 1))
                kinds = [(slice(ends[k], ends[k + 1]), [x.doc_type is None or x.doc_type == told[k] for x in limits]) for k in range(len(told))]
                for group in groups[block]:
                    group.add(points, np.sqrt((points**2).sum(1)), columns, kinds, tuple(np.array(pairs, int).reshape(-1, 2).T))
        values = [pa.array(list(c), names[n]) for c, n in ((docs, "doc"), (types, "doc_type"))]
        for group in (g for each in groups.values() for g in each):
            group.prune()
            for rows in group.rows:
                score = lambda c: pa.array(rows[c], mask=~rows["regular"])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows["query"] + group.first)), pa.array(rows["chunk_id"], names["chunk_id"]), values[0].take(pa.array(rows["doc"])), values[1].take(pa.array(rows["kind"])), score("score_original"), score("score")], ["query_id", *names, "score_original", "score"])

    fields = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for d, some in ((queries, ["query_id"]), (chunks, list(names))) for c in some)
    rows = chunks.select("chunk_id", "doc", "doc_type", "vector")
    if blocks > 1:
        # task p has the query block p % blocks and the part p // blocks of the chunks
        parts = max(1, tasks // blocks)
        part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int") * blocks
        dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartitionById(parts * blocks, part + F.col("block"))
    else:
        dealt = rows.withColumn("block", F.lit(0))
    return checkpointed(dealt.mapInArrow(search, f"{fields}, score_original double, score double"))


def topk(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best rows of each query with their rank; ties go to the lesser chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _take(rows: DataFrame, pool: Column, by: str, target: Column, cap: int | None) -> DataFrame:
    """V9: pick the best unpicked rows of the pool until ``target`` are picked, at most ``cap`` of a document in all."""
    free = pool & ~F.col("picked")
    step = rows.withColumns(
        {
            "free": free,
            "used": F.sum(F.col("picked").cast("int")).over(Window.partitionBy("query_id", "doc")),
            "have": F.sum(F.col("picked").cast("int")).over(Window.partitionBy("query_id")),
        }
    )
    step = step.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "doc", "free").orderBy(F.desc(by), "chunk_id")))
    may = F.col("free") & ((F.col("place") <= cap - F.col("used")) if cap else F.lit(True))
    step = step.withColumn("may", may)
    turn = F.row_number().over(Window.partitionBy("query_id", "may").orderBy(F.desc(by), "chunk_id"))
    step = step.withColumn("turn", turn).withColumn("goal", target)
    return step.withColumn("picked", F.col("picked") | (F.col("may") & (F.col("turn") <= F.col("goal") - F.col("have")))).select(*rows.columns)


def _best(rows: DataFrame, by: str, per_doc: int | None, most: int) -> DataFrame:
    """The ``most`` best rows of each query, of the ``per_doc`` best ones of each document."""
    limited = lambda df, keys, n: df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), "chunk_id"))).filter(F.col("place") <= n).drop("place")
    return limited(limited(rows, ["query_id", "doc"], per_doc) if per_doc else rows, ["query_id"], most)


def quota_limits(k: int = 10, per_doc: int | None = 2, academic: int = 0, public: int = 5, public_per_doc: int | None = 1) -> list[Limit]:
    """Limits that all rows which ``quota_topk`` can pick are within.

    The public stage picks the best ones of its pool outright. Before a later stage at most public + academic rows
    are picked; of a document at most as many as its caps allow. So of a document's rows the best that many and
    ``per_doc`` more can matter, and of a query's documents the best that are full already and k more.
    """
    public, public_per_doc = min(public, k), public_per_doc or per_doc
    before = public + academic
    each = per_doc + min(before, max(per_doc, public_per_doc or before)) if per_doc else None
    most = (before + k) * (each or 1)
    limits = [Limit("score", most, None, each)]
    if academic:
        limits.append(Limit("score", most, "academic", each))
    if public:
        limits.append(Limit("score_original", public, "public", public_per_doc))
    return limits


def _candidates(scored: DataFrame, k: int, per_doc: int | None, academic: int, public: int, public_per_doc: int | None) -> DataFrame:
    """All rows that ``quota_topk`` can pick, and few others."""
    found = None
    for limit in quota_limits(k, per_doc, academic, public, public_per_doc):
        own = _best(scored if limit.doc_type is None else scored.filter(F.col("doc_type") == limit.doc_type), limit.by, limit.per_doc, limit.most)
        found = own if found is None else found.unionByName(own)
    return found.dropDuplicates(["query_id", "chunk_id"])


def quota_topk(scored: DataFrame, k: int = 10, per_doc: int | None = 2, academic: int = 0, public: int = 5, public_per_doc: int | None = 1) -> DataFrame:
    """V8: first public rows by the original form, then academic rows, then the rest, under caps for each document.

    A cap of None or 0 is none. Quotas are targets. Ranks follow the fused score.
    """
    rows = _candidates(scored, k, per_doc, academic, min(public, k), public_per_doc or per_doc).withColumn("picked", F.lit(False))
    if public:
        rows = _take(rows, F.col("doc_type") == "public", "score_original", F.lit(min(public, k)), public_per_doc or per_doc)
    if academic:
        rows = _take(rows, F.col("doc_type") == "academic", "score", F.least(F.col("have") + academic, F.lit(k)), per_doc)
    rows = _take(rows, F.lit(True), "score", F.lit(k), per_doc)
    return topk(rows.filter("picked").drop("picked"), k)
