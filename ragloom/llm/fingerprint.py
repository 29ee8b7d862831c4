"""Operator 9: document fingerprints by consistent weighted sampling.

A text is a weighted set: its lower-cased words, each with its number of places. For each of ``SAMPLES`` samples
and each term, gamma variables r and c and a uniform b, all taken from a hash of the term and the sample's
number, turn the weight w into t = floor(ln w / r + b) and ln a = ln c - r * (t - b + 1). The sample is the term
of least a with its t. Two sets agree on a sample with the probability of their generalised Jaccard similarity,
the sum of lesser weights over the sum of greater ones.

Terms are exploded within a task and their minima taken by one aggregation beside it: the rows of a text are
dealt once, by a range of doc_id and text hash, and what follows (the next document, terms, samples, the next document's
fingerprint) needs no other shuffle.

Nulls: a null text counts as empty, a null doc_id comes first. A text without words has the fingerprint "" and
is alike (1) only to another such. Rows of equal doc_id are ordered by their texts' hashes; repeated rows are
rows of their own. An id that many rows share is split among ranges by its texts' hashes; only rows of equal id and
text stay together. A lone document is its own next one. Very long texts are one row, whose terms are spread. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, words

SAMPLES, DIGITS = 32, 6
#: ln a is kept to 1 / SCALE, above the bits of the sample's value.
SCALE, VALUE_BITS = float(1 << 24), 4 * DIGITS
#: Spreads t over the bits of the value.
SPREAD = 0x9E3779B1
#: Ranges of documents for each shuffle partition.
RANGES_EACH, LOW = 8, -(1 << 63)
#: Starts of ranges that stand in an expression.
MOST_STARTS = 256


def terms(text: Column) -> Column:
    """The sorted hashes of a text's lower-cased words, repeats included."""
    return F.sort_array(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def _runs(hashes: Column) -> Column:
    """From sorted hashes: where each run of equal ones starts."""
    return F.filter(F.transform(hashes, lambda h, i: F.when((i == 0) | (F.get(hashes, i - 1) != h), i)), lambda i: i.isNotNull())


def _weighted(hashes: Column, starts: Column) -> Column:
    """From sorted hashes and their runs' starts: (t, w), a distinct word's hash and the logarithm of its count."""
    n = F.size(hashes)
    return F.transform(starts, lambda s, k: F.struct(F.get(hashes, s).alias("t"), F.ln((F.coalesce(F.get(starts, k + 1), n) - s).cast("double")).alias("w")))


def _uniform(h: Column, at: int, bits: int) -> Column:
    """A number in (0, 1) from ``bits`` bits of a hash."""
    mask = F.lit((1 << bits) - 1).cast("long")
    return (F.shiftrightunsigned(h, at).bitwiseAND(mask) + 0.5) / F.lit(float(1 << bits))


def _sample(k: int) -> Column:
    """ln a of sample k above the low bits of a hash of (term, t), as one long whose minimum is the sample.

    A Gamma(2, 1) variable is -ln of the product of two uniform ones.
    """
    h = F.xxhash64(F.col("t"), F.lit(k))
    g = F.xxhash64(h)
    r = -F.ln(_uniform(h, 0, 21) * _uniform(h, 21, 21))
    ln_c = F.ln(-F.ln(_uniform(g, 0, 32) * _uniform(g, 32, 32)))
    b = _uniform(h, 42, 21)
    t = F.floor(F.col("w") / r + b)
    ln_a = ln_c - r * (t - b + 1)
    value = g.bitwiseXOR(t * SPREAD).bitwiseAND(F.lit((1 << VALUE_BITS) - 1).cast("long"))
    return F.shiftleft(F.floor(ln_a * SCALE), VALUE_BITS).bitwiseOR(value)


def samples(rows: DataFrame, keys: list[str], weighted: str) -> DataFrame:
    """One row for each ``keys`` with f_m0, f_m1, ...: the samples of its terms, null without terms."""
    spread = rows.select(*keys, F.explode_outer(weighted).alias("x")).select(*keys, F.col("x.t").alias("t"), F.col("x.w").alias("w"))
    return spread.groupBy(*keys).agg(*[F.min(_sample(k)).alias(f"f_m{k}") for k in range(SAMPLES)])


def signature(prefix: str) -> Column:
    """The samples' values as an array, null without terms."""
    value = F.lit((1 << VALUE_BITS) - 1).cast("long")
    return F.when(F.col(f"{prefix}0").isNotNull(), F.array(*[F.col(f"{prefix}{k}").bitwiseAND(value) for k in range(SAMPLES)]))


def as_hex(signature: Column) -> Column:
    """DIGITS hexadecimal digits a sample; "" without terms."""
    return F.coalesce(F.lower(F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v), DIGITS, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that agree; two texts without terms agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(SAMPLES))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def _cuts(ids: list[int]) -> list[tuple[int, int]]:
    """Range starts (id, hash) from sorted quantiles of the ids: an id that occurs m times among them is cut into m by hash."""
    return [(x, LOW + k * ((1 << 64) // m)) for x, m in sorted(Counter(ids).items()) for k in range(m)]


def in_ranges(docs: DataFrame, count: int) -> DataFrame:
    """Rows (f_range, f_tail, f_id, f_hash, doc_id, text): documents in about ``count`` ranges of id and text hash, each ended by the first row of the next.

    The ranges' starts are quantiles of doc_id, at most MOST_STARTS, which the driver holds; more ranges are made by cutting
    each evenly. A table of one row a range tells each one's first row. That row is repeated (f_tail = 1) as the end of
    the range before, the very first one as the end of the last; so a window within a range finds each document's next one.
    """
    starts, each = min(count, MOST_STARTS), -(-count // MOST_STARTS)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("f_id")).withColumn("f_hash", F.xxhash64("text"))
    found = keyed.agg(F.min("f_id").alias("low"), F.max("f_id").alias("high"), F.percentile_approx("f_id", [k / starts for k in range(1, starts)] or [0.5], 20 * starts).alias("q")).first()
    cuts = _cuts([found.low, *(found.q or [])]) if found.low is not None else [(LOW, LOW)]
    ranged = _with_range(keyed, cuts, each, LOW if found.high is None else found.high)
    first = ranged.groupBy("f_range").agg(F.min(F.struct("f_id", "f_hash")).alias("f"))
    # one row a range
    order = Window.orderBy("f_range")
    last = F.max("f_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = first.select(F.col("f_range").alias("r"), F.col("f.f_id").alias("i"), F.col("f.f_hash").alias("h"), F.coalesce(F.lag("f_range").over(order), last).alias("before"))
    marked = ranged.join(F.broadcast(first), F.col("f_range") == F.col("r"))
    one = lambda r, tail: F.struct(F.col(r).alias("r"), F.lit(tail).alias("tail"))
    is_first = (F.col("i") == F.col("f_id")) & (F.col("h") == F.col("f_hash"))
    both = F.when(is_first, F.array(one("f_range", 0), one("before", 1))).otherwise(F.array(one("f_range", 0)))
    return marked.withColumn("x", F.explode(both)).select(F.col("x.r").alias("f_range"), F.col("x.tail").alias("f_tail"), "f_id", "f_hash", "doc_id", "text")


def _with_range(keyed: DataFrame, cuts: list[tuple[int, int]], each: int, high: int) -> DataFrame:
    """``keyed`` with f_range, the index of the last of ``cuts`` at most (f_id, f_hash), by halving, a column a step; each cut evenly into ``each``."""
    n = len(cuts)
    bounds = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(h).cast("long").alias("h")) for i, h in cuts])
    step = 1 << max(0, n - 1).bit_length()
    out = keyed.withColumn("f_range", F.lit(0))
    while step := step // 2:
        further = F.col("f_range") + step
        out = out.withColumn("f_range", F.when(F.get(bounds, further) <= F.struct(F.col("f_id").alias("i"), F.col("f_hash").alias("h")), further).otherwise(F.col("f_range")))
    if each == 1:
        return out
    low, end = F.get(bounds, F.col("f_range"))["i"].cast("double"), F.coalesce(F.get(bounds, F.col("f_range") + 1)["i"], F.lit(high)).cast("double")
    part = F.when(end > low, F.least(F.lit(each - 1), F.floor((F.col("f_id") - low) / (end - low) * each))).otherwise(F.lit(0))
    return out.withColumn("f_range", (F.col("f_range") * each + part).cast("int"))


def fingerprint_next(docs: DataFrame) -> DataFrame:
    """The contract's columns for rows (doc_id, text)."""
    hashed = in_ranges(docs, RANGES_EACH * shuffle_partitions(docs.sparkSession))
    order = Window.partitionBy("f_range").orderBy("f_tail", "f_id", "f_hash")
    placed = hashed.withColumns({"f_place": F.row_number().over(order), "f_next": F.lead("text").over(order)})
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    placed = placed.withColumn("f_edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("f_next", F.lit("")), F.lit(1), quarter)))
    keep = ["f_range", "f_place", "f_tail", "doc_id", "n_chars", "edited_sha256"]
    sized = placed.withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2(F.col("f_edited").cast("binary"), 256))
    # a tail row needs its own fingerprint only
    forms = F.when(F.col("f_tail") == 1, F.array("text")).otherwise(F.array("text", "f_edited"))
    each = sized.select(*keep, F.posexplode(forms).alias("f_form", "f_text")).withColumn("f_sorted", terms(F.col("f_text")))
    each = each.withColumn("f_starts", _runs(F.col("f_sorted"))).withColumn("f_terms", _weighted(F.col("f_sorted"), F.col("f_starts")))
    drawn = samples(each, [*keep, "f_form"], "f_terms")
    of_form = lambda form, name: [F.max(F.when(F.col("f_form") == form, F.col(f"f_m{k}"))).alias(f"{name}{k}") for k in range(SAMPLES)]
    pair = drawn.groupBy(*keep).agg(*of_form(0, "f_own"), *of_form(1, "f_new")).select(*keep, signature("f_own").alias("own"), signature("f_new").alias("edited"))
    after = F.struct(F.col("own"), F.lit(1).alias("there"))
    ahead = pair.withColumn("f_after", F.lead(after).over(Window.partitionBy("f_range").orderBy("f_place")))
    return ahead.filter("f_tail = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("f_after.own")).alias("near_next"),
    )


def op9_weighted_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    return fingerprint_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
