"""Operator 7: secret scans by a battery of randomness tests.

Besides the contract's three patterns, tokens of 20 or more characters of at least two kinds (digits, small letters,
capitals) are candidates. The smallest alphabet that holds a token is its encoding. Three tests look at its symbols:
the chi-squared statistic of uniformity over the alphabet, runs, and the correlation of neighbours. A token that any
of them calls not random (p < NOT_RANDOM) is left. For the others the null hypothesis is text: symbols that agree
more often than uniform ones, and kinds of characters that seldom change. The statistic of uniformity is too low for
that, and the runs of kinds are too many, if the token is random; both normal scores together give the token's
p-value, which falls with its length. Of a document's p-values, each divided by the token's length over the mean
length, the Benjamini-Hochberg step-up rule at level RATE picks the secrets, so that at most that share of a
document's added spans is expected to be text.

Nulls: a null text counts as empty: no spans. Very long texts with many matches take time in proportion: places are
running sums, overlaps are found in one pass over the sorted spans, and pieces are cut from blocks of the text. Ties
and repeated rows need nothing special: each row is scanned by itself. An empty table gives no rows. Extra columns
are ignored by the query and kept by ``redact``, whatever their names; ``scan`` gives them as the struct x_row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blocks_of, bound, part_of, running, settled

#: Fixed patterns of the contract, in its order: kind, pattern, the group that must be long, its least length, and
#: words of which a match has one, after lower-casing. A run of hexadecimal digits, or one after AKIA, is matched as
#: a whole or not at all, so there the least length may be part of the pattern.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, ("akia",)),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, ()),
)
CANDIDATE, LEAST = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", 20
NOT_RANDOM, RATE = 0.001, 0.03
#: How often a digit stands beside a letter, or a capital after a small letter, in the null hypothesis: words, numbers and separators.
CHANGES = 0.15
#: Encoding: what its tokens look like, its alphabet, how often two symbols of the null hypothesis agree.
#: For letters that is about 0.066 in English text; for hexadecimal digits twice the uniform chance.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.125),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.066),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.05),
    ("base64", "^[0-9A-Za-z+/_-]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", 0.05),
)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,token:string>>"


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int, cues: tuple[str, ...] = ()) -> Column:
    """Matches from left to right, as (start, rank, end, kind, token) in code points, those with a short group left out.

    Finding a word is much cheaper than a search that ignores case, so only texts with one of ``cues`` are searched.
    The text between matches, as ``split`` gives it, and the matches themselves tell where each match ends.
    """
    p = F.lit(pattern)
    found = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("part"), F.split(text, pattern, -1).alias("between"))

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["between"], 1, F.size(x["whole"])), x["whole"], lambda b, m: F.length(b) + F.length(m))
        ends = running(steps, F.lit(0), lambda a, n: a + n, "int")
        spans = F.transform(ends, lambda end, k: F.struct((end - F.length(F.get(x["whole"], k))).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.get(x["whole"], k).alias("token")))
        return F.filter(spans, lambda _, k: F.length(F.get(x["part"], k)) >= least)

    hit = text.rlike(pattern)
    if cues:
        hinted = F.contains("x_low", F.lit(cues[0]))
        for cue in cues[1:]:
            hinted = hinted | F.contains("x_low", F.lit(cue))
        hit = hinted & hit
    return F.when(hit, bound(found, placed)).otherwise(F.array().cast(SPAN))


def _normal(z: Column) -> Column:
    """The standard normal distribution function, by a logistic curve that is off by less than 0.0002."""
    z = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z))
    return 1 / (1 + F.exp(-z * (1.5976 + 0.07056 * z * z)))


def _two_sided(z: Column) -> Column:
    return 2 * _normal(-F.abs(z))


def _choose(token: Column, field: int) -> Column:
    out = None
    for encoding in ENCODINGS[:-1]:
        out = (F.when if out is None else out.when)(token.rlike(encoding[1]), F.lit(encoding[field]))
    return out.otherwise(F.lit(ENCODINGS[-1][field]))


def battery(spans: Column) -> Column:
    """``spans`` as (start, end, token, p): those that may be random, with the null hypothesis's p-value."""
    # each step adds one struct, so that what is used twice is computed once
    coded = F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["token"].alias("token"),
            F.when(x["token"].rlike(ENCODINGS[0][1]) | (~x["token"].rlike(ENCODINGS[1][1]) & x["token"].rlike(ENCODINGS[2][1])), F.lower(x["token"])).otherwise(F.translate(x["token"], "_-", "/+")).alias("low"),
            _choose(x["token"], 2).alias("alphabet"),
            _choose(x["token"], 3).alias("agree"),
        ),
    )
    valued = F.transform(
        coded,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["token"].alias("token"),
            x["agree"].alias("agree"),
            (F.length(F.regexp_replace(x["token"], "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])", " ")) - F.length(x["token"])).cast("double").alias("changes"),
            F.length(x["low"]).cast("double").alias("n"),
            F.length(x["alphabet"]).cast("double").alias("k"),
            F.transform(F.filter(F.split(x["low"], ""), lambda c: c != ""), lambda c: F.call_function("instr", x["alphabet"], c).cast("double") - 1).alias("v"),
            F.aggregate(F.array_distinct(F.filter(F.split(x["low"], ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a + F.pow((F.length(x["low"]) - F.length(F.call_function("replace", x["low"], c, F.lit("")))).cast("double"), F.lit(2.0))).alias("squares"),
        ),
    )

    def statistics(x: Column) -> Column:
        n, k, v = x["n"], x["k"], x["v"]
        middle = (k - 1) / 2
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = F.aggregate(pairs, F.lit(1.0), lambda s, y: s + F.when((y["a"] > middle) != (y["b"] > middle), 1.0).otherwise(0.0))
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, y: s + (y["a"] - middle) * (y["b"] - middle))
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["token"].alias("token"),
            n.alias("n"),
            k.alias("k"),
            ((x["changes"] - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))).alias("z_kinds"),
            (n * (k * x["agree"] - 1)).alias("excess"),
            (k / n * x["squares"] - n).alias("chi"),
            ((runs - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("z_runs"),
            (serial / ((k * k - 1) / 12 * F.sqrt(n - 1))).alias("z_serial"),
        )

    measured = F.transform(valued, statistics)
    random = F.filter(
        measured,
        lambda x: (1 - _normal((x["chi"] - x["k"] + 1) / F.sqrt(2 * (x["k"] - 1))) >= NOT_RANDOM) & (_two_sided(x["z_runs"]) >= NOT_RANDOM) & (_two_sided(x["z_serial"]) >= NOT_RANDOM),
    )
    null = lambda x: _normal(((x["chi"] - x["k"] + 1 - x["excess"]) / F.sqrt(2 * (x["k"] - 1) + 4 * x["excess"]) - x["z_kinds"]) / F.sqrt(F.lit(2.0)))
    return F.transform(random, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"), x["n"].alias("n"), null(x).alias("p")))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows x_row (``docs``' row), x_text, x_low, x_assign, x_access, x_hex (spans of the base kinds) and x_maybe (all candidates)."""
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("x_row"), F.coalesce(F.col(text), F.lit("")).alias("x_text")).withColumn("x_low", F.lower("x_text"))
    step = step.withColumns({f"x_{kind}": settled(_spans(F.col("x_text"), kind, rank, pattern, group, least, cues)) for rank, (kind, pattern, group, least, cues) in enumerate(BASE)})
    return step.withColumn("x_maybe", settled(_spans(F.col("x_text"), "random", len(BASE), CANDIDATE, 0, LEAST)))


def _apart(base: Column, maybe: Column) -> Column:
    """Spans of ``maybe`` that overlap none of ``base``; each array is sorted. One pass from the left and one from the right over both."""

    def kept(both: Column) -> Column:
        left = running(both, F.lit(0), lambda a, x: F.when(x["rank"] < len(BASE), F.greatest(a, x["end"])).otherwise(a), "int")
        right = F.reverse(running(F.reverse(both), F.lit((1 << 31) - 1), lambda a, x: F.when(x["rank"] < len(BASE), F.least(a, x["start"])).otherwise(a), "int"))
        return bound(F.struct(left.alias("left"), right.alias("right")), lambda e: F.filter(both, lambda x, k: (x["rank"] == len(BASE)) & (F.get(e["left"], k) <= x["start"]) & (F.get(e["right"], k) >= x["end"])))

    return F.when((F.size(base) > 0) & (F.size(maybe) > 0), bound(F.sort_array(F.concat(base, maybe)), kept)).otherwise(maybe)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``with_candidates`` with x_base and x_spans: sorted arrays of (start, rank, end, kind, token), the base kinds' and all."""
    step = with_candidates(docs, text).withColumn("x_base", settled(F.sort_array(F.concat("x_assign", "x_access", "x_hex"))))
    kinds = lambda x: sum((x["token"].rlike(kind).cast("int") for kind in ("[0-9]", "[a-z]", "[A-Z]")), F.lit(0))
    step = step.withColumn("x_maybe", settled(_apart(F.col("x_base"), F.filter("x_maybe", lambda x: kinds(x) >= 2))))
    # most texts have no candidate: nothing more is computed for them
    none = F.array().cast("array<struct<start:int,end:int,token:string,n:double,p:double>>")
    step = step.withColumn("x_tested", settled(F.when(F.size("x_maybe") > 0, battery(F.col("x_maybe"))).otherwise(none)))
    mean = F.aggregate("x_tested", F.lit(0.0), lambda a, x: a + x["n"]) / F.greatest(F.size("x_tested"), F.lit(1))
    step = step.withColumn("x_mean", settled(mean)).withColumn("x_ps", settled(F.sort_array(F.transform("x_tested", lambda x: x["p"] * F.col("x_mean") / x["n"]))))
    m = F.size("x_maybe")
    passed = F.filter("x_ps", lambda p, k: p <= RATE * (k + 1) / m)
    step = step.withColumn("x_limit", settled(F.coalesce(F.array_max(passed), F.lit(-1.0))))
    added = F.transform(
        F.filter("x_tested", lambda x: x["p"] * F.col("x_mean") / x["n"] <= F.col("x_limit")),
        lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("rank"), x["end"].alias("end"), F.lit("random").alias("kind"), x["token"].alias("token")),
    )
    return step.withColumn("x_spans", settled(F.sort_array(F.concat("x_base", added))))


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of the text (overlapping ones as one) replaced by ``mark``; a null text stays null."""
    scanned = scan(docs, text)

    def step(a: Column, s: Column) -> Column:
        # what stands before the span and after all earlier ones, and whether the span begins past those
        return F.struct(a["end"].alias("from"), s["start"].alias("to"), F.greatest(a["end"], s["end"]).alias("end"))

    def clean(blocks: Column) -> Column:
        steps = running(F.col("x_spans"), F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(0).alias("end")), step, "struct<from:int,to:int,end:int>")
        put = F.transform(F.filter(steps, lambda x: x["to"] >= x["from"]), lambda x: F.concat(part_of(blocks, x["from"], x["to"]), F.lit(mark)))
        rest = part_of(blocks, F.array_max(F.transform("x_spans", lambda x: x["end"])), F.length("x_text"))
        return F.concat(F.array_join(put, ""), rest)

    cleaned = F.when(F.size("x_spans") > 0, bound(blocks_of(F.col("x_text")), clean)).otherwise(F.col(f"x_row.`{text}`"))
    return scanned.select(*[(settled(cleaned) if c == text else F.col(f"x_row.`{c}`")).alias(c) for c in docs.columns])


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(f"x_{kind}").cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    return found.select("x_row.doc_id", *counts, F.sha2(described(F.col("x_base")).cast("binary"), 256).alias("base_sha256"), described(F.col("x_spans")).alias("spans"))
