"""What cleaning costs: lines are read once, and units are parsed once for both strategies."""

import random
import re
import time

from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import textclean
from ragloom.plans import building

S = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0   　"


def lines(seed, n=400):
    rng = random.Random(seed)
    parts = ["12", "12345", "0", "http://a", "https://", "www.x\xa0y", "www.", " ", "\t", "\xa0", "　", "\x1d", "\x85", " ", "가", "x", "。", "-", "7a", "é", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(n)]


def test_a_long_run_of_spaces_is_stripped_in_one_pass(spark):
    """the search for white space at the end began anew at every space of a run within a line."""
    docs = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 300_000), F.lit("b")).alias("text"))
    start = time.monotonic()
    kept = textclean.kept_lines(F.col("text"), F.array(F.lit("x")))
    assert docs.select(F.length(T.strip(F.col("text"))).alias("n"), F.size(kept).alias("k")).collect() == [(300_002, 1)]
    assert time.monotonic() - start < 10


def test_kept_lines_are_those_of_plain_patterns(spark):
    """F14."""
    texts = ["\n".join(x.replace("\n", " ") for x in lines(k, 12)) for k in range(60)]
    rows = spark.createDataFrame([(k, t, ["7a", "x"] if k % 3 == 0 else []) for k, t in enumerate(texts)], "k int, text string, edges array<string>")
    for r in rows.select("k", "text", "edges", textclean.kept_lines(F.col("text"), F.col("edges")).alias("kept")).collect():
        every = r.text.split("\n")
        bare = [x.strip(S) for x in every]
        gone = [b in r.edges or (re.fullmatch("[0-9]{1,4}", b) and (i < 3 or i >= len(every) - 3)) or re.fullmatch("(https?://|www\\.)[^ \t\n\x0b\f\r]+", b) for i, b in enumerate(bare)]
        assert r.kept == [x for x, g in zip(every, gone) if not g]
    every = lines(9)
    got = spark.createDataFrame(list(enumerate(every)), "k int, t string").orderBy("k").select(T.strip(F.col("t")).alias("s"), T.normalise(F.col("t")).alias("n"), textclean.without_noise(F.col("t"), F.array().cast("array<string>")).alias("w")).collect()
    assert [r.s for r in got] == [x.strip(S) for x in every]
    assert [r.w for r in got] == ["\n".join(y for y in x.split("\n") if len(re.findall("[가-힣A-Za-z0-9]", y)) >= 3) for x in every]
    assert [r.n for r in got] == [re.sub("[\x00-\x08\x0b-\x1f\x7f]", "", re.sub("[\t\xa0　]", " ", x)) for x in every]


def test_lines_are_not_replaced_to_count_their_letters(spark):
    """a page's noise is found without a second text for each line."""
    df = spark.createDataFrame([("a1b\n!!a", ["Licensed under"])], "t string, e array<string>").select(textclean.without_noise(F.col("t"), F.col("e")).alias("w"))
    assert df.collect() == [("a1b",)]
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_units_are_parsed_once_for_both_strategies(spark, sf_dir):
    """F8."""
    assert "k_pairs" not in building.chunk_build(spark, sf_dir)._jdf.queryExecution().analyzed().toString()
