"""Near-duplicate detection by character n-grams: D1 shingles, D2 Jaccard pairs, D3 exclusion, D4 notes.

Texts of equal shingle sets are one class, so that a group of copies is met once. Candidates share a band of their MinHash
signatures (``shingles``): a fixed number of rows for each text, however long it is. Those that meet are joined to
components, and within a component texts are compared block by block: first all signatures of two blocks, then, where
signatures agree often enough, the sets themselves, whose intersections are counted exactly. A text's set so goes to each
block that holds a likely partner once, and not to each partner.

A pair of similarity ``least`` is missed with a chance below 1e-9, one of a higher similarity with less; that is of the order
of what 64-bit hashes of shingles confuse. ``prefix_pairs`` is the way without that chance: an equi-join on the rarest
shingles of each set, which any similar set must share, at the price of shuffling every shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, filter_after
from ..sources.sinks import checkpointed, delete, small_batches, written
from . import shingles as sets
from .graph import components

NEAR, SAME, SIZE = 0.6, 0.98, 10
#: Texts and shingles of a block, rows of signatures and shingles that are compared in one call, and edges of a component that one call decides.
BLOCK, BLOCK_SHINGLES, CALL_ROWS, CALL_SHINGLES, CALL_EDGES = 1024, 1 << 20, 8192, 1 << 20, 200_000
#: Shingles of a component that is walked in one call, and of what one call walks if components are smaller: enough calls for every core.
WALK_SHINGLES, WALK_CALL = 16 << 20, 1 << 20
#: Most slots of the map of ids that are looked up. A full map only costs time.
MOST_SLOTS = 1 << 23
#: Distinct texts that a task remembers, so that copies are read once.
KEPT_TEXTS = 500_000


def shingles(chars: Column, size: int = SIZE) -> Column:
    """The distinct n-grams of an array of characters, as 64-bit hashes; fewer characters have none."""
    n = F.size(chars)
    grams = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(chars, i + k) for k in range(size)]))
    return F.when(n >= size, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))


def shingle_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows (doc_id, lang, shingles, n). Texts are read without white space; characters are taken apart once."""
    chars = F.regexp_extract_all(F.regexp_replace("text", f"[{SPACE}]+", ""), F.lit("(?s)."), F.lit(0))
    split = docs.select("doc_id", "lang", chars.alias("chars"))
    return split.select("doc_id", "lang", shingles(F.col("chars"), size).alias("shingles")).withColumn("n", F.size("shingles"))


def shingle_counts(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows (doc_id, n): how many distinct n-grams a text has."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = [len(sets.shingle_set(text.as_py(), size)) for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["doc_id", "n"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n long")


def _texts(docs: DataFrame, size: int, cut: sets.Plan | None) -> DataFrame:
    """Rows (doc_id, node, n, sig, spots) of documents with shingles. A node is a class of equal sets of one language.

    With ``cut``: once in each task for each node of a language, the signature's bytes and its bands' keys.
    """
    small_batches(docs.sparkSession)
    names, kinds = ["doc_id", "node", "n", "sig", "spots"], (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in parts:
            rows = []
            for doc_id, lang, text in zip(*(column.to_pylist() for column in part.columns)):
                found = sets.shingle_set(text, size)
                if len(found):
                    node, sig, spots = sets.set_key(found, lang), None, None
                    if cut and doc_id is not None and lang is not None and node not in seen:
                        if len(seen) >= KEPT_TEXTS:
                            seen.clear()
                        seen.add(node)
                        values = sets.signature(found, cut.values)
                        sig, spots = values.astype(np.uint8).tobytes(), sets.bands(values, cut, lang)
                    rows.append((doc_id, node, len(found), sig, spots))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(batches, "doc_id long, node long, n int, sig binary, spots array<long>")


def _components(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (node, root, n) of texts that meet others on bands, directly or over others."""
    met = found.filter("spots is not null").select("node", F.explode("spots").alias("spot"))
    # bands are shuffled once, and a band's texts are read in order, never gathered
    least = F.first("node").over(Window.partitionBy("spot").orderBy("node"))
    joined = components(met.select("node", least.alias("low")).filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")))
    return checkpointed(joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct()).join(classes.select("node", "n"), "node"))


def _blocks(found: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (part, i, j, block, node, n, sig): the texts of each two blocks, i <= j, of a component."""
    sized = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sized, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = found.filter("sig is not null").select("node", "sig").join(placed, "node").dropDuplicates(["node"])
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select(F.col("root").alias("part"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "sig")


def _calls(df: DataFrame, count: int) -> DataFrame:
    """``df`` with the number of the call that holds its blocks."""
    return df.withColumn("call", F.pmod(F.xxhash64("part", "i", "j"), F.lit(max(1, count))).cast("int"))


def _groups(table: pa.Table) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """The blocks of a call with their rows' places."""
    keys = [table[c].to_numpy() for c in ("part", "i", "j")]
    order = np.lexsort(keys[::-1])
    at = np.array(keys)[:, order]
    starts = np.flatnonzero(np.append(True, (at[:, 1:] != at[:, :-1]).any(0))) if len(order) else []
    for start, end in zip(starts, [*starts[1:], len(order)]):
        yield tuple(at[:, start].tolist()), order[start:end]


def _likely(blocks: DataFrame, cut: sets.Plan, least: float) -> DataFrame:
    """Rows (part, i, j, u, v): texts of two blocks whose sizes and signatures allow the similarity."""
    names = ["part", "i", "j", "u", "v"]

    def compare(table: pa.Table) -> pa.Table:
        node, n, block = (table[c].to_numpy() for c in ("node", "n", "block"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(node), cut.values)
        found = []
        for key, rows in _groups(table):
            i, j = key[1:]
            for k, row in enumerate(rows[:-1]):
                rest = rows[k + 1 :]
                if i < j:  # texts of one block are compared in that block alone
                    rest = rest[block[rest] != block[row]]
                likely = ((sig[rest] == sig[row]).sum(1) >= cut.agree) & (np.minimum(n[rest], n[row]) >= least * np.maximum(n[rest], n[row]))
                found += [(*key, node[row], x) for x in node[rest[likely]].tolist()]
        return pa.table([pa.array([int(f[k]) for f in found], pa.int64()) for k in range(5)], names)

    grouped = _calls(blocks, -(-blocks.count() // CALL_ROWS)).groupBy("call")
    return grouped.applyInArrow(lambda table: compare(table), ", ".join(f"{c} long" for c in names))


def _intersections(rows: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[int]:
    """The sizes of intersections of pairs of sets, by places in ``rows``."""
    if len(pairs) <= 2 * len(rows):
        return [len(np.intersect1d(rows[a], rows[b], assume_unique=True)) for a, b in pairs]
    every, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, which, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[which] > 1
    number = np.cumsum(times > 1) - 1
    which, owner = number[which[shared]], owner[shared]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    total, step = np.zeros((len(rows), len(rows)), np.int64), max(1, (1 << 24) // len(rows))
    for start in range(0, int(number[-1]) + 1, step):
        a, b = np.searchsorted(which, [start, start + step])
        held = np.zeros((step, len(rows)), np.float32)
        held[which[a:b] - start, owner[a:b]] = 1
        total += (held.T @ held).astype(np.int64)
    return [int(total[a, b]) for a, b in pairs]


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is among ``ids`` (id), and few others: a map of bits tells them, so that other texts aren't shuffled."""
    size = min(MOST_SLOTS, 1 << (16 * ids.count() + 1).bit_length())
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(size))
    taken = ids.select(slot("id").alias("slot")).distinct()
    words = taken.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    held = words.toArrow().to_pydict()
    table = np.zeros(size // 64 + 1, np.int64)
    table[np.array(held["word"], np.int64)] = np.array(held["bits"], np.int64)
    bits = docs.sparkSession.sparkContext.broadcast(table)
    last = len(docs.columns)

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.column(last).to_numpy()
            yield pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1]).filter(pa.array((bits.value[at >> 6] >> (at & 63) & 1).astype(bool)))

    small_batches(docs.sparkSession)
    return docs.select("*", slot("doc_id").alias("slot")).mapInArrow(kept, docs.schema)


def _counted(likely: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """Rows (u, v, inter) of likely pairs: each text goes once to the two blocks that it is compared in, and its set is made there."""
    places = [F.col(c).alias(c) for c in ("part", "i", "j")]  # columns of their own, as both sides are grouped
    wanted = checkpointed(likely.select(*places, F.explode(F.array("u", "v")).alias("node")).distinct().join(classes, "node"))
    calls = -(-(wanted.agg(F.sum("n")).first()[0] or 0) // CALL_SHINGLES)
    read = _of_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter("doc_id is not null"), wanted.select("id").distinct())
    sent = _calls(wanted.join(read, F.col("id") == F.col("doc_id")).select("part", "i", "j", "node", "lang", "text"), calls)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        places = dict(_groups(right))
        nodes, langs, texts = right["node"].to_pylist(), right["lang"], right["text"]
        u, v, out = left["u"].to_numpy(), left["v"].to_numpy(), np.zeros(len(left), np.int64)
        for key, rows in _groups(left):
            held: dict[int, np.ndarray] = {}
            for k in places[key]:
                # rows of one id may differ: the text of the class counts
                if nodes[k] not in held and sets.set_key(found := sets.shingle_set(texts[k].as_py(), size), langs[k].as_py()) == nodes[k]:
                    held[nodes[k]] = found
            place = {node: k for k, node in enumerate(held)}
            out[rows] = _intersections(list(held.values()), [(place[a], place[b]) for a, b in zip(u[rows].tolist(), v[rows].tolist())])
        return pa.table([left["u"], left["v"], pa.array(out)], ["u", "v", "inter"])

    return _calls(likely, calls).groupBy("call").cogroup(sent.groupBy("call")).applyInArrow(lambda a, b: count(a, b), "u long, v long, inter long")


def _read(docs: DataFrame, least: float, size: int) -> tuple[DataFrame, DataFrame, DataFrame, sets.Plan, str]:
    """What one reading of the texts gives: rows of ``_texts``, classes (node, id, n), members (doc_id, class_id), the plan, a path to delete."""
    cut = sets.plan(least, docs.count())
    found, path = written(_texts(docs, size, cut))
    classes = checkpointed(found.groupBy("node").agg(F.min("doc_id").alias("id"), F.max("n").alias("n")))
    members = checkpointed(found.select("doc_id", "node").join(classes.select("node", F.col("id").alias("class_id")), "node").select("doc_id", "class_id"))
    return found, classes, members, cut, path


def _pairs(found: DataFrame, classes: DataFrame, members: DataFrame, docs: DataFrame, cut: sets.Plan, least: float, size: int) -> DataFrame:
    """Rows (a, b, inter, jaccard) of components ``members``."""
    likely = checkpointed(_likely(checkpointed(_blocks(found, members)), cut, least))
    near = _counted(likely, docs, classes, size)
    for side in "uv":
        near = near.join(classes.select(F.col("node").alias(side), F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n")), side)
    rated = near.withColumn("jaccard", F.col("inter") / (F.col("u_n") + F.col("v_n") - F.col("inter")))
    return checkpointed(filter_after(rated, F.col("jaccard") >= least).select(F.least("u_id", "v_id").alias("a"), F.greatest("u_id", "v_id").alias("b"), "inter", "jaccard"))


def classes_and_pairs(docs: DataFrame, least: float = NEAR, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """``class_members`` and ``jaccard_pairs`` of one reading of the texts."""
    found, classes, members, cut, path = _read(docs, least, size)
    pairs = _pairs(found, classes, _components(found, classes), docs, cut, least, size)
    delete(docs.sparkSession, path)
    return members, pairs


def copies_excluded(docs: DataFrame, same: float = SAME, size: int = SIZE) -> DataFrame:
    """Rows (doc_id, excluded_by) of all classes, named by their least doc_id, without the pairs of a large family.

    The rows of ``content_exclusion`` over all pairs. The walk in order of id only needs what isn't excluded: a component of
    up to WALK_SHINGLES shingles is walked in one call, each text against the ones that stay so far. Larger components
    go through their pairs.
    """
    found, classes, members, cut, path = _read(docs, same, size)
    placed = _components(found, classes)
    placed = checkpointed(placed.join(placed.groupBy("root").agg(F.sum("n").alias("shingles")), "root"))
    walked = checkpointed(_walked(placed.filter(F.col("shingles") <= WALK_SHINGLES), docs, classes, cut, same, size))
    large = checkpointed(placed.filter(F.col("shingles") > WALK_SHINGLES).select("node", "root", "n"))
    if not large.isEmpty():
        pairs = _pairs(found, classes, large, docs, cut, same, size)
        walked = walked.unionByName(content_exclusion(large.join(classes.select("node", F.col("id").alias("doc_id")), "node").select("doc_id"), pairs, same).filter("excluded_by is not null"))
    delete(docs.sparkSession, path)
    return members.filter("doc_id = class_id").select("doc_id").distinct().join(walked, "doc_id", "left").select("doc_id", "excluded_by")


def _walked(members: DataFrame, docs: DataFrame, classes: DataFrame, cut: sets.Plan, same: float, size: int) -> DataFrame:
    """Rows (doc_id, excluded_by) of the excluded texts of components (node, root, n), each walked in one call, many in each."""
    wanted = checkpointed(members.select("node", "root", "n").join(classes.select("node", "id"), "node"))
    calls = -(-(wanted.agg(F.sum("n")).first()[0] or 0) // WALK_CALL)
    read = _of_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter("doc_id is not null"), wanted.select("id"))
    sent = wanted.join(read, F.col("id") == F.col("doc_id")).select("root", "id", "node", "lang", "text", F.pmod(F.xxhash64("root"), F.lit(max(1, calls))).cast("int").alias("call"))

    def walk(table: pa.Table) -> pa.Table:
        roots, ids, nodes = (np.array(table[c].to_pylist(), np.int64) for c in ("root", "id", "node"))
        langs, texts, out = table["lang"], table["text"], []
        stay: list[tuple[int, np.ndarray]] = []
        marks, root, last = np.zeros((0, cut.values), np.uint32), None, None
        for k in np.lexsort((ids, roots)).tolist():
            if roots[k] != root:
                root, stay, last = roots[k], [], None
                marks = np.zeros((16, cut.values), np.uint32)
            found = sets.shingle_set(texts[k].as_py(), size)
            # rows of one id may differ: the text of the class counts, once
            if nodes[k] == last or sets.set_key(found, langs[k].as_py()) != nodes[k]:
                continue
            last, mark = nodes[k], sets.signature(found, cut.values)
            for at in np.flatnonzero((marks[: len(stay)] == mark).sum(1) >= cut.agree).tolist():
                other, n = stay[at][1], len(found)
                if same * max(n, len(other)) <= min(n, len(other)):
                    inter = len(np.intersect1d(found, other, assume_unique=True))
                    if inter / (n + len(other) - inter) >= same:
                        out.append((ids[k], stay[at][0]))
                        break
            else:
                if len(stay) == len(marks):
                    marks = np.concatenate([marks, np.zeros_like(marks)])
                marks[len(stay)] = mark
                stay.append((ids[k], found))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["doc_id", "excluded_by"])

    return sent.groupBy("call").applyInArrow(lambda table: walk(table), "doc_id long, excluded_by long")


def jaccard_pairs(docs: DataFrame, least: float = NEAR, size: int = SIZE) -> DataFrame:
    """Pairs (a < b) of classes of one language with similarity ``least`` or more: (a, b, inter, jaccard).

    A class is the documents of one set of shingles, named by the least doc_id. Documents without a language or without
    shingles are in no pair.
    """
    return classes_and_pairs(docs, least, size)[1]


def prefix_pairs(docs: DataFrame, least: float = NEAR, size: int = SIZE) -> DataFrame:
    """D2 without any chance of a missed pair: the rows of ``jaccard_pairs`` by a join on prefixes.

    Only shingles in a prefix of each set, rarest first, are joined: two sets of similarity t share one of their
    (1 - t) * n + 1 rarest shingles. Every distinct shingle is shuffled.
    """
    # the sets are used four times and dear to make, so they are written once
    sets = checkpointed(filter_after(shingle_sets(docs, size).withColumn("key", F.xxhash64(F.sort_array("shingles"))), F.col("n") > 0))
    classes = sets.groupBy("lang", "key", "n").agg(F.min("doc_id").alias("id"))
    members = sets.join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "lang", "shingles", "n")
    each = members.select("id", "lang", "n", F.explode("shingles").alias("s"))
    often = each.groupBy("lang", "s").agg(F.count("*").alias("f")).filter("f > 1")
    # each set's shared shingles, rarest first; those past the prefix can't be the first shared one
    ranked = each.join(often, ["lang", "s"]).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("f", "s")))
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    prefix = ranked.withColumn("alone", alone).filter(F.col("place") + F.col("alone") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    left = prefix.select("lang", "s", F.col("id").alias("a"), F.col("n").alias("na"))
    right = prefix.select("lang", "s", F.col("id").alias("b"), F.col("n").alias("nb"))
    sized = F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")
    pairs = left.join(right, ["lang", "s"]).filter((F.col("a") < F.col("b")) & sized).select("a", "b").distinct()
    sets_of = members.select("id", "shingles", "n")
    for side in "ab":
        pairs = pairs.join(sets_of.select(F.col("id").alias(side), F.col("shingles").alias(f"s{side}"), F.col("n").alias(f"n{side}")), side)
    inter = F.size(F.array_intersect("sa", "sb"))
    return pairs.withColumn("inter", inter).withColumn("jaccard", F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).filter(F.col("jaccard") >= least).select("a", "b", "inter", "jaccard")


def class_members(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows (doc_id, class_id) for documents with shingles."""
    found = checkpointed(_texts(docs, size, None).select("doc_id", "node"))
    return found.join(found.groupBy("node").agg(F.min("doc_id").alias("class_id")), "node").select("doc_id", "class_id")


def content_exclusion(live: DataFrame, pairs: DataFrame, same: float = SAME) -> DataFrame:
    """D3: rows (doc_id, excluded_by) for live documents (doc_id, in order) and their pairs (a < b, jaccard).

    A document is excluded by the first earlier one of similarity ``same`` or more that isn't excluded itself: an
    excluded document excludes none. That is a walk in order of id within each component of such pairs. Components of
    up to CALL_EDGES pairs are walked in one call, many in each. Larger ones are decided in rounds: those documents whose
    earlier partners are all decided, at least the first open one. Pairs of documents that aren't live don't count.
    """
    mine = live.select("doc_id")
    edges = pairs.filter(F.col("jaccard") >= same).select("a", "b")
    for side in "ab":
        edges = edges.join(mine.withColumnRenamed("doc_id", side), side, "left_semi")
    edges = checkpointed(edges)
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = checkpointed(edges.join(roots.withColumnRenamed("node", "b"), "b"))
    rooted = checkpointed(rooted.join(rooted.groupBy("root").agg(F.count("*").alias("edges")), "root"))
    near = checkpointed(_decided(rooted.filter(F.col("edges") <= CALL_EDGES)))
    edges = checkpointed(rooted.filter(F.col("edges") > CALL_EDGES).select("a", "b"))
    far = _decided_by_rounds(edges)
    done = near.unionByName(far)
    return mine.join(done, "doc_id", "left").select("doc_id", "excluded_by")


def _decided(rooted: DataFrame) -> DataFrame:
    """Rows (doc_id, excluded_by) of the excluded documents of components (a, b, root, edges) that fit one call, many of them in each."""
    count = -(-rooted.count() // CALL_EDGES)

    def decide(table: pa.Table) -> pa.Table:
        by: dict[int, int] = {}
        for b, a in sorted(zip(table["b"].to_pylist(), table["a"].to_pylist())):
            if a not in by:
                by.setdefault(b, a)
        return pa.table([pa.array(by.keys(), pa.int64()), pa.array(by.values(), pa.int64())], ["doc_id", "excluded_by"])

    dealt = rooted.select("a", "b", F.pmod(F.xxhash64("root"), F.lit(max(1, count))).cast("int").alias("call"))
    return dealt.groupBy("call").applyInArrow(lambda table: decide(table), "doc_id long, excluded_by long")


def _decided_by_rounds(edges: DataFrame) -> DataFrame:
    """Rows (doc_id, excluded_by) of the excluded documents of edges (a, b), in rounds."""
    if edges.isEmpty():
        return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("excluded_by"))
    paired = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    decided = paired.select("doc_id", F.lit(None).cast("long").alias("by")).join(edges.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti")
    left = None
    while True:
        open_ = checkpointed(paired.join(decided, "doc_id", "left_anti").select("doc_id"))
        before, left = left, open_.count()
        if not left:
            break
        if left == before:
            raise RuntimeError(f"{left} documents have earlier partners that aren't live")
        known = edges.join(open_, edges.b == open_.doc_id, "left_semi").join(decided.select(F.col("doc_id").alias("a"), F.lit(True).alias("ready"), "by"), "a", "left")
        step = known.groupBy("b").agg(F.count_if(F.col("ready").isNull()).alias("waits"), F.min(F.when(F.col("ready") & F.col("by").isNull(), F.col("a"))).alias("by"), F.min(F.when(F.col("ready").isNull(), F.col("a"))).alias("first_open"))
        # an earlier exclusion than any open partner's is final too
        done = step.filter("waits = 0 or by < first_open").select(F.col("b").alias("doc_id"), "by")
        decided = checkpointed(decided.unionByName(done))
    return decided.filter("by is not null").select("doc_id", F.col("by").alias("excluded_by"))


def similar_notes(docs: DataFrame, excluded: DataFrame, pairs: DataFrame, same: float = SAME) -> DataFrame:
    """Rows (doc_id, verdict, reason) of docs (doc_id, verdict, reason) after the content check.

    ``excluded``: ``content_exclusion``. ``pairs``: (a < b, jaccard). A document whose verdict is use and that is
    excluded by content has that as its reason. Another one of verdict use is noted beside each similar document, in
    their order, as ``similar: id 83%``: all pairs but those whose earlier document excludes the later one.
    """
    gone = docs.join(excluded, "doc_id", "left").withColumn("used", (F.col("verdict") == "use") & F.col("excluded_by").isNull())
    used = gone.select(F.col("doc_id").alias("a"), F.col("used").alias("a_used"))
    kept = pairs.join(used, "a").filter((F.col("jaccard") < same) | ~F.col("a_used"))
    both = kept.select(F.col("a").alias("doc_id"), F.col("b").alias("other"), "jaccard").unionByName(kept.select(F.col("b").alias("doc_id"), F.col("a").alias("other"), "jaccard"))
    note = F.concat(F.lit("similar: "), F.col("other").cast("string"), F.lit(" "), F.bround(F.col("jaccard") * 100, 0).cast("int").cast("string"), F.lit("%"))
    notes = both.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("other", note.alias("n")))), lambda x: x["n"]).alias("notes"))
    joined = gone.join(notes, "doc_id", "left")
    own = F.when(F.col("reason") != "", F.col("reason"))
    reason = F.when(F.col("excluded_by").isNotNull(), F.concat(F.lit("content duplicate: "), F.col("excluded_by").cast("string"))).when(F.col("used"), F.concat_ws(" | ", own, F.array_join("notes", " | "))).otherwise(F.col("reason"))
    return joined.select("doc_id", F.when(F.col("excluded_by").isNotNull(), "exclude").otherwise(F.col("verdict")).alias("verdict"), F.regexp_replace(reason, " \\| $", "").alias("reason"))
