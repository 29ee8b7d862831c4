"""Operator 2: mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the corpus over its actual share. Each document draws
its number of copies by inverting the Poisson distribution of that mean at a uniform number taken from a
seeded hash of its id, is exploded by that count, and all copies are dealt and sorted by a second hash, which
shuffles them globally. Copies of one document fall on unrelated places.

Nulls: a null source has no target weight and takes the rate of the unlisted sources; a null size counts as 0;
a null doc_id is hashed as an empty string. Repeated rows draw the same count. A listed source without rows has
no rate: the other weights are scaled up. A listed source with hardly any rows has a large rate; its
copies are made in blocks over many tasks, and 2^31 or more copies of one row are an error.
Ties in the order are copies of repeated rows. Very long texts are moved once, and looked at nowhere. An empty table
gives no rows. Extra columns are kept; the columns that the operator adds are named by parameters, and a clash is an
error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settled, unused

#: Target shares of the characters. Unlisted sources share what is left.
TARGET_WEIGHTS = {"src0": 0.15, "src1": 0.06, "src2": 0.06, "src3": 0.06, "src4": 0.06}
SEED = "mix-1"
#: A larger rate is drawn as the sum of so many equal parts that none is larger: a sum of Poisson variables is one.
MOST_STEP = 500.0
#: Copies of a row that are made from one array, where a rate comes near that.
COPY_BLOCK = 1 << 20


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the seed and the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: float) -> list[float]:
    """The values of the Poisson distribution function up to where it no longer grows; a count is how many of them a uniform number reaches."""
    if not 0 <= rate <= MOST_STEP:
        raise ValueError(f"a mean repetition rate of {rate} isn't between 0 and {MOST_STEP}")
    term = total = math.exp(-rate)
    steps, k = [total], 0
    while True:
        k += 1
        term = term * rate / k
        if k > rate and total + term == total:
            return steps
        total += term
        steps.append(total)


def rates(docs: DataFrame, weights: dict[str, float], source: str = "source", size: Column | None = None) -> tuple[dict[str, float], float]:
    """The mean rate of each listed source, and that of all others. One aggregation; a row for each listed source returns."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must not be negative, nor sum to more than 1")
    size = F.coalesce(F.col("n_chars") if size is None else size, F.lit(0))
    listed = F.when(F.col(source).isin(*weights), F.col(source)) if weights else F.lit(None).cast("string")
    sums = {r[0]: int(r[1]) for r in docs.groupBy(listed.alias("s")).agg(F.sum(size).cast("decimal(38,0)")).collect()}
    total = sum(sums.values())
    rest = max(0.0, 1 - sum(weights.values()))
    present = sum(w for s, w in weights.items() if sums.get(s)) + (rest if sums.get(None) else 0.0)
    if not total or not present:
        return {s: 0.0 for s in weights}, 1.0
    rate = lambda weight, n: weight * total / (present * n) if n else 0.0
    return {s: rate(w, sums.get(s, 0)) for s, w in weights.items()}, rate(rest, sums.get(None, 0))


def copies(by_source: dict[str, float], other: float, seed: str, key: str = "doc_id", source: str = "source") -> Column:
    """The number of copies of a row."""

    def reached(rate: float) -> Column:
        parts = max(1, math.ceil(rate / MOST_STEP))
        steps = F.array(*map(F.lit, poisson_steps(rate / parts)))
        one = lambda u: F.size(F.filter(steps, lambda step: u >= step))
        if parts == 1:
            return one(uniform(F.col(key), seed))
        drawn = lambda k: one(uniform(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), k.cast("string")), seed))
        return F.aggregate(F.sequence(F.lit(1), F.lit(parts)), F.lit(0), lambda a, k: a + drawn(k))

    out = None
    for s, rate in by_source.items():
        out = F.when(F.col(source) == s, reached(rate)) if out is None else out.when(F.col(source) == s, reached(rate))
    return reached(other) if out is None else out.otherwise(reached(other))


def mix(docs: DataFrame, weights: dict[str, float], seed: str = SEED, copy_column: str = "copy_no", order_column: str = "shuffle_key") -> DataFrame:
    """``docs`` replicated to the target weights of the characters and shuffled globally.

    Adds ``copy_column`` (from 0) and ``order_column`` (a hash; the rows of a partition are in its order, and
    partitions are dealt by it). Needs doc_id, source, n_chars.
    """
    if clash := {copy_column, order_column} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    by_source, other = rates(docs, weights)
    count = copies(by_source, other, seed)
    if 2 * max(other, *by_source.values(), 0) < COPY_BLOCK:
        drawn = docs.withColumn(copy_column, F.explode(F.sequence(F.lit(0), F.when(count > 0, count - 1))))
    else:
        # a row that is due so often is dealt in blocks of copies, so that neither an array nor a task holds all of them
        n, block = unused(docs, "mix_count"), unused(docs, "mix_block")
        counted = docs.withColumn(n, settled(count))
        blocks = counted.withColumn(block, F.explode(F.sequence(F.lit(0), F.when(F.col(n) > 0, F.col(n) - 1), F.lit(COPY_BLOCK)))).repartition("doc_id", block)
        drawn = blocks.withColumn(copy_column, F.explode(F.sequence(F.col(block), F.least(F.col(block) + COPY_BLOCK - 1, F.col(n) - 1)))).drop(n, block)
    named = drawn.withColumn(order_column, F.md5(F.concat_ws(":", F.lit(f"{seed}:place"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(copy_column).cast("string"))))
    return named.repartition(F.col(order_column)).sortWithinPartitions(order_column)


def op2_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` mixed to TARGET_WEIGHTS, with their texts."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"), TARGET_WEIGHTS)


_LISTED = ", ".join(f"('{s}', CAST({w!r} AS DOUBLE))" for s, w in TARGET_WEIGHTS.items())

OP2_SQL = f"""
WITH RECURSIVE weight(source, w) AS (VALUES {_LISTED}),
rest AS (SELECT greatest(CAST(0 AS DOUBLE), 1 - CAST({sum(TARGET_WEIGHTS.values())!r} AS DOUBLE)) AS w),
sums AS (
  SELECT weight.source, sum(coalesce(n_chars, 0))::DOUBLE AS n
  FROM documents LEFT JOIN weight ON documents.source = weight.source GROUP BY 1),
present AS (
  SELECT sum(coalesce(weight.w, rest.w)) AS p, sum(n) AS total
  FROM sums CROSS JOIN rest LEFT JOIN weight ON sums.source = weight.source WHERE n > 0),
rate AS (
  SELECT sums.source, CASE WHEN n > 0 THEN coalesce(weight.w, rest.w) * total / (p * n) ELSE 0 END AS mean
  FROM sums CROSS JOIN rest CROSS JOIN present LEFT JOIN weight ON sums.source = weight.source),
steps(source, mean, k, term, total) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM rate
  UNION ALL
  SELECT source, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1)
  FROM steps WHERE NOT (k + 1 > mean AND total + term * mean / (k + 1) = total)),
drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, weight.source AS listed,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM documents d LEFT JOIN weight ON d.source = weight.source),
counted AS (
  SELECT doc_id, text, lang, drawn.source, n_chars, count(*) AS copies
  FROM drawn JOIN steps ON drawn.listed IS NOT DISTINCT FROM steps.source AND u >= total
  GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no,
  md5('{SEED}:place:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no) AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS copy_no FROM counted)
"""
