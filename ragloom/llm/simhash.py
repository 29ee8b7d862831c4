"""Operator 10: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 * r`` bits apart have a common variant at most ``r`` bits from each. So every
distinct fingerprint emits all its variants within half the radius, variants are shuffled, and fingerprints
that meet on a variant are verified. All fingerprints on one variant lie within ``2 * r`` of each other, so
linking each with the next on that variant keeps every component, without all pairs.

Nulls: a null text counts as empty (fingerprint zero, linked like any other); a row with a null doc_id keeps
its row. Repeated rows share one fingerprint and are never compared. Ties: a bit that just half of the hashes have is
0; a component is named by its least doc_id. Very long texts are hashed CHUNK shingles at a time. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .components import components

SHINGLE_WORDS, RADIUS, SEED, CHUNK = 3, 2, 42, 1 << 15


def shingle_hashes(text: str | None, size: int, start: int = 0) -> Iterator[np.ndarray]:
    """Arrays of the XXH64 hashes of a text's word shingles in order, a bounded number at a time."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII spaces split
    if not words:
        return
    if len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    digest, last = xxhash.xxh64_intdigest, len(words) - size + 1
    for at in range(0, last, CHUNK):
        part = words[at : min(at + CHUNK, last) + size - 1]
        yield np.array([digest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(size)))], np.uint64)


def fingerprint(parts: Iterable[np.ndarray]) -> int:
    """The 64-bit fingerprint of arrays of hashes: a bit is 1 if more than half of the hashes have it. No hashes: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text's word shingles."""
    return fingerprint(shingle_hashes(text, size))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of each whole text as a signed long."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints = [_signed(simhash(text, size)) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``bits`` bits, as signed longs."""
    return [_signed(sum(1 << b for b in chosen)) for k in range(radius + 1) for chosen in combinations(range(bits), k)]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (u, v) of verified fingerprints at most ``radius`` (an even number) bits apart.

    ``prints`` has distinct longs fp. Not every pair within the radius has a row, but each such pair is
    connected by rows: what meets on a variant is linked in a chain.
    """
    if radius % 2:
        raise ValueError("the radius must be even: variants reach half of it")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(64, radius // 2)])
    met = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = met.select("fp", before.alias("other")).filter("other is not null").distinct()
    return pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).select(F.col("fp").alias("u"), F.col("other").alias("v"))


def near_components(docs: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp, component_id): component_id is the least doc_id reachable over links, itself included."""
    found = checkpointed(fingerprints(docs, size))
    least = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least.select("fp"), radius))
    rooted = checkpointed(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(rooted.select("fp", "root").join(groups, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's query: whole ``documents``, 3-word shingles, links at 2 or fewer differing bits."""
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
