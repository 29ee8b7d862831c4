"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its lesser neighbours to the least of them. Rows have u > v."""
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("c"))
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for each node of ``edges`` (longs u, v; any order, repeats and loops allowed).

    root is the least node of the component; roots themselves have no row. No edges: no rows. A node's
    neighbours are never gathered: each step takes minima, which combine before the shuffle, and joins,
    whose hot keys adaptive execution splits. Each round is checkpointed.
    """
    now = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state
        now = checkpointed(_small_star(_large_star(now)))
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
