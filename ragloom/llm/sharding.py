"""Operator 6: minimax contiguous partition into shards.

Groups of equal texts stay whole. Groups are ordered by the 64-bit hash of their text, and that order is cut
into contiguous shards so that the largest shard is as small as possible: a binary search over the capacity,
each capacity checked by greedy filling.

The greedy check needs the last group end at or before a position, for few positions. It runs on a coarse table
of hash ranges and their sizes, of bounded length, which the driver holds. Whatever that table can't decide yet
(a position inside a range of several groups) is decided both ways, which brackets the least capacity; only the
ranges that the bracket touches are split into finer ones, all in one aggregation, until the answer is exact.
Cuts are hash values, so that placing rows is an expression: no join, no shuffle.

Nulls: null texts form one group, of 0 bytes and the row's fixed cost each. Repeated rows are rows of their own
in one group. A group larger than an even share makes the capacity that group's size. An empty table gives no
rows; shards may be empty. Ties: equal rows have neighbouring slots. Very long texts are hashed and measured once, and
never moved. Two texts of equal 64-bit hash share a group, which keeps every promise. Extra
columns are ignored by the query and kept by ``assign``.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, crc32_text

SHARDS, ROW_BYTES = 24, 8
#: log2 of the ranges of the first table, and of the parts that a range is split into.
FIRST_BITS, SPLIT_BITS = 12, 8
#: Parts of a shard that are numbered apart, so that no task numbers a whole shard.
SLOT_PARTS = 256
#: Slots of equal rows that are made from one array.
SLOT_BLOCK = 1 << 20
LOW = -(1 << 63)


@dataclass
class Ranges:
    """Adjacent hash ranges in order: first hash, log2 of the width, bytes, groups and the greatest hash that occurs."""

    rows: list[tuple[int, int, int, int, int]]
    ends: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rows.sort()
        self.ends = list(accumulate(r[2] for r in self.rows))

    def fill(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Positions of greedy cuts.

        Inside a range of several groups the last group end before a position isn't known: the hopeful way takes
        the position itself, the other way the range's start. The true cuts lie between the two ways' cuts.
        """
        at, cuts = 0, []
        while len(cuts) < shards and at < self.ends[-1]:
            k = bisect_right(self.ends, at + capacity)
            if k == len(self.ends):
                at = self.ends[-1]
            elif hopeful and self.rows[k][3] > 1:
                at += capacity
            else:
                at = max(at, self.ends[k - 1] if k else 0)
            cuts.append(at)
        return cuts + [at] * (shards - len(cuts))

    def least(self, shards: int, hopeful: bool) -> int:
        """The least capacity that fits, by binary search."""
        low, high = 0, self.ends[-1]
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fill(middle, shards, hopeful)[-1] >= self.ends[-1] else (middle + 1, high)
        return low


def cut_points(groups: DataFrame, shards: int = SHARDS, first_bits: int = FIRST_BITS, split_bits: int = SPLIT_BITS) -> tuple[int, list[int]]:
    """The least capacity and the last hash of each shard but the last, for rows (h long, bytes long), one a group."""

    def ranges(df: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
        # shifting keeps the sign, so that ranges are in the order of signed hashes
        by = df.groupBy(F.shiftleft(F.shiftright("h", bits), bits).alias("start"))
        return [(r["start"], bits, r["b"], r["n"], r["top"]) for r in by.agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("h").alias("top")).collect()]

    rows = ranges(groups, 64 - first_bits)
    while rows:
        known = Ranges(rows)
        low, high = known.least(shards, True), known.least(shards, False)
        if low == high:
            places = (bisect_right(known.ends, at) for at in known.fill(low, shards, False)[:-1])
            return low, [known.rows[k - 1][4] if k else LOW for k in places]
        # what may hold a cut for a capacity of the bracket is split, each width in one aggregation
        touched: set[int] = set()
        for a, b in zip(known.fill(low, shards, False), known.fill(high, shards, True), strict=True):
            touched |= {k for k in range(bisect_right(known.ends, a), min(bisect_right(known.ends, b), len(rows) - 1) + 1) if known.rows[k][3] > 1}
        rows = [r for k, r in enumerate(known.rows) if k not in touched]
        for bits in sorted({known.rows[k][1] for k in touched}):
            mine = [known.rows[k][0] >> bits for k in touched if known.rows[k][1] == bits]
            rows += ranges(groups.filter(F.shiftright("h", bits).isin(mine)), max(0, bits - split_bits))
    return 0, []


def assign(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with s_hash, s_bytes and s_shard, and the capacity that no shard exceeds."""
    sized = docs.withColumn("s_hash", F.xxhash64("text")).withColumn("s_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + row_bytes)
    # copies are summed before the shuffle, so that a hot text is one row of each task
    groups = checkpointed(sized.groupBy(F.col("s_hash").alias("h")).agg(F.sum("s_bytes").alias("bytes")))
    capacity, last = cut_points(groups, shards)
    shard = sum((F.when(F.col("s_hash") > h, 1).otherwise(0) for h in last), F.lit(0))
    return sized.withColumn("s_shard", shard.cast("int")), capacity


def numbered(rows: DataFrame, parts: int = SLOT_PARTS) -> DataFrame:
    """``rows`` (doc_id, s_hash, s_shard, ...) with slot: gapless from 0 within each shard.

    Equal rows are counted first, so that they are one row however many they are. Each shard is numbered in ``parts``
    parts by a hash of doc_id and text; the parts' offsets are a table of at most shards x parts rows, so that it may
    be broadcast.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("s_n"))
    split = counted.withColumn("s_part", F.pmod(F.xxhash64("doc_id", "s_hash", F.lit("slot")), F.lit(parts)).cast("int"))
    own = Window.partitionBy("s_shard", "s_part").orderBy("doc_id", "s_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = split.withColumn("s_end", F.sum("s_n").over(own))
    counts = rows.groupBy("s_shard", F.pmod(F.xxhash64("doc_id", "s_hash", F.lit("slot")), F.lit(parts)).cast("int").alias("s_part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("s_shard").orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("s_shard", "s_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s_offset"))
    last = placed.join(F.broadcast(offsets), ["s_shard", "s_part"]).withColumn("s_end", F.col("s_offset") + F.col("s_end") - 1)
    # in blocks, so that no array grows with the number of equal rows
    first = F.col("s_end") - F.col("s_n") + 1
    blocks = last.withColumn("s_block", F.explode(F.sequence(first, F.col("s_end"), F.lit(SLOT_BLOCK).cast("long"))))
    return blocks.withColumn("slot", F.explode(F.sequence(F.col("s_block"), F.least(F.col("s_block") + SLOT_BLOCK - 1, F.col("s_end"))))).drop("s_block")


def op6_minimax_shards(spark, sf_dir: str) -> DataFrame:
    """The contract's query: whole ``documents`` in 24 shards under the law ``bytes``."""
    docs, _ = assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = docs.select("doc_id", F.col("s_bytes").alias("size"), crc32_text(F.col("text")).alias("text_crc32"), "s_hash", "s_shard")
    return numbered(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("s_shard").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
