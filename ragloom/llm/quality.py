"""Operator 3: quality rules as a learned decision list.

Statistics of each whole text are Spark expressions. Sequential covering learns the list from all labelled
statistics: it grows a conjunction of thresholds on one part of them, prunes it on the other, keeps it if it is precise
enough, sets aside the rows that it covers, and goes on. Rows stay on Spark: what learning asks for are counts of
rejected and kept rows by feature and threshold, and by rule, each an aggregate of bounded size. The list is emitted as one
ordered ``CASE WHEN`` expression, so that applying it needs no join and no Python.

Nulls: a null text has no words (all statistics 0) and fails the base rules; labelled rows with a null label or
doc_id are left out of learning. Repeated rows each get their own row. Empty tables: no rows; without labels
of both classes the list is empty and only the base rules decide. Ties in learning go to the rule that covers more
rejected rows, then to the first test by feature, side and cut. Very long texts are read whole, as arrays of words and
hashes of one row. Extra columns are ignored by the query and kept by ``with_statistics`` and ``apply_rules``, whose
own columns start with ``q_``: an input column of such a name gives way to theirs, but ``kept_rows`` returns it as it was.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settled
from .common import checkpointed, count_of, words

#: Base rules of the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Up to so many labelled ids are broadcast, so that only their texts are counted; more are joined to the counts of all.
BROADCAST_IDS = 1 << 20
#: A feature's values are looked at in intervals of this part of their power of two; so many rules are counted at once.
INTERVALS, AT_ONCE = 256, 32
#: A rule must be so precise on the labelled rows, cover so many rejected rows, and have at most so many tests.
PRECISION, LEAST_COVER, MOST_TESTS, MOST_RULES, CUTS, BEAM = 0.97, 8, 3, 12, 40, 8

#: Name to expression over the statistics; what rules test.
FEATURES = {
    "q_words": "cast(q_n_words as double)",
    "q_word_length": "q_word_chars / greatest(q_n_words, 1)",
    "q_symbols": "q_n_symbols / greatest(q_n_words, 1)",
    "q_bangs": "q_n_bangs / greatest(q_n_words, 1)",
    "q_capitals": "q_n_capitals / greatest(q_word_chars, 1)",
    "q_same_lines": "q_n_dup_lines / greatest(q_n_lines, 1)",
    "q_repeats": "q_n_repeat_words / greatest(q_n_words, 1)",
}


@dataclass(frozen=True)
class Test:
    """feature >= cut, or feature < cut."""

    feature: str
    over: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.cut) == self.over

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.cut) if self.over else F.col(self.feature) < F.lit(self.cut)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows q_row (``docs``' row) with the contract's counts (q_n_words, q_word_chars, q_n_symbols, q_n_dup_lines, q_n_repeat_words) and FEATURES.

    Windows of three words are compared by 64-bit hash within one text. Only texts with a repeated window
    sort their windows by place.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row")
    step = docs.select(row, F.coalesce(F.col(text), F.lit("")).alias("q_text")).withColumn("q_list", settled(words(F.col("q_text"))))
    window = F.transform(F.sequence(F.lit(0), F.size("q_list") - 3), lambda i: F.xxhash64(F.get("q_list", i), F.get("q_list", i + 1), F.get("q_list", i + 2)))
    step = step.withColumn("q_windows", settled(F.when(F.size("q_list") < 3, F.array().cast("array<bigint>")).otherwise(window)))
    placed = F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    step = step.withColumn("q_sorted", settled(F.when(repeated, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))))
    twice = F.filter("q_sorted", lambda x, k: (F.get("q_sorted", k - 1)["h"] == x["h"]) | (F.get("q_sorted", k + 1)["h"] == x["h"]))
    step = step.withColumn("q_places", settled(F.sort_array(F.transform(twice, lambda x: x["i"]))))
    # each window covers three words, less what the window before it has covered
    covered = F.aggregate("q_places", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    step = step.withColumn("q_lines", settled(F.filter(F.split("q_text", "\n"), lambda line: line.rlike("[^ \\x09-\\x0D]"))))
    counts = {
        "q_n_words": F.size("q_list").cast("long"),
        "q_word_chars": F.length(F.array_join("q_list", "")).cast("long"),
        "q_n_symbols": count_of(F.col("q_text"), "#*$%&|<>"),
        "q_n_bangs": count_of(F.col("q_text"), "!"),
        "q_n_capitals": count_of(F.col("q_text"), "A-Z"),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_n_repeat_words": covered,
    }
    step = step.select("q_row", *[settled(how).alias(name) for name, how in counts.items()])
    return step.withColumns({name: F.expr(how) for name, how in FEATURES.items()})


def _unpacked(found: DataFrame) -> DataFrame:
    """The rows of q_row with the other columns beside theirs."""
    own = [c for c in found.columns if c != "q_row"]
    kept = [c for c in found.schema["q_row"].dataType.names if c.lower() not in own]
    return found.select(*[F.col(f"q_row.`{c}`").alias(c) for c in kept], *own)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``statistics``."""
    return _unpacked(statistics(docs, text))


def base_failed() -> Column:
    """The contract's base rules over ``with_statistics``."""
    return (F.col("q_n_words") < LEAST_WORDS) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * MOST_REPEATED)


Rule = tuple[int, ...]
#: The least and the greatest value of each interval, in order.
Spans = list[tuple[float, float]]


class _Tests:
    """The thresholds that rules are made of: of each feature its cuts in order, and all tests by number."""

    def __init__(self, spans: dict[str, tuple[Spans, Spans]]) -> None:
        # cuts lie halfway between neighbouring values, spread over the rejected rows and over all rows
        self.cuts: dict[str, list[float]] = {}
        for f in FEATURES:
            found = set()
            for part in spans[f]:
                places = {round(k * (len(part) - 1) / CUTS) for k in range(1, CUTS)} if len(part) > CUTS else range(1, len(part))
                found |= {(part[k - 1][1] + part[k][0]) / 2 for k in places if k}
            self.cuts[f] = sorted(found)
        self.tests = sorted((Test(f, over, cut) for f in FEATURES for cut in self.cuts[f] for over in (True, False)), key=lambda t: (t.feature, t.over, t.cut))
        #: A test holds where the number of the feature's cuts up to the value is over this, or isn't.
        self.at = [self.cuts[t.feature].index(t.cut) for t in self.tests]

    def covered(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        """How many rows each test holds for, from the numbers of rows by feature and cuts up to their values."""
        above = {f: n[::-1].cumsum()[::-1] for f, n in counts.items()}
        return np.array([above[t.feature][k + 1] if t.over else above[t.feature][0] - above[t.feature][k + 1] for t, k in zip(self.tests, self.at)], np.int64)


class _Rows:
    """Labelled rows on the driver, a list of FEATURES and ``bad``: what ``_Table`` is on Spark."""

    def __init__(self, rows: list[dict], seed: int) -> None:
        rows = sorted(rows, key=lambda r: tuple(r[f] for f in FEATURES) + (r["bad"],))
        random.Random(seed).shuffle(rows)
        self.bad, self.grow = np.array([r["bad"] for r in rows], bool), np.arange(len(rows)) < len(rows) * 2 // 3
        self.values = {f: np.array([r[f] for r in rows], float) for f in FEATURES}

    def spans(self) -> dict[str, tuple[Spans, Spans]]:
        of = lambda v: [(x, x) for x in sorted(set(v.tolist()))]
        return {f: (of(v[self.grow & self.bad]), of(v[self.grow])) for f, v in self.values.items()}

    def cut(self, tests: _Tests) -> None:
        self.tests = tests
        self.places = {f: np.searchsorted(tests.cuts[f], v, side="right") for f, v in self.values.items()}

    def _holds(self, rule: Rule) -> np.ndarray:
        held = np.ones(len(self.bad), bool)
        for k in rule:
            held &= (self.places[self.tests.tests[k].feature] > self.tests.at[k]) == self.tests.tests[k].over
        return held

    def _left(self, gone: list[Rule]) -> np.ndarray:
        return ~np.array([self._holds(rule) for rule in gone], bool).reshape(len(gone), len(self.bad)).any(0)

    def by_test(self, rules: list[Rule], gone: list[Rule]) -> list[tuple[np.ndarray, np.ndarray]]:
        left, out = self._left(gone) & self.grow, []
        for rule in rules:
            held = left & self._holds(rule)
            out.append(tuple(self.tests.covered({f: np.bincount(p[held & side], minlength=len(self.tests.cuts[f]) + 1) for f, p in self.places.items()}) for side in (self.bad, ~self.bad)))
        return out

    def by_rule(self, rules: list[Rule], gone: list[Rule]) -> list[tuple[int, int, int, int]]:
        left = self._left(gone)
        return [tuple(int((left & self._holds(rule) & part & side).sum()) for part in (self.grow, ~self.grow) for side in (self.bad, ~self.bad)) for rule in rules]


class _Table:
    """Labelled rows (doc_id, FEATURES, bad) of distinct ids on Spark. The driver gets counts: of intervals, of cuts, of rules."""

    def __init__(self, rows: DataFrame, seed: int = 5) -> None:
        grow = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)) < 2
        self.rows = checkpointed(rows.select(*FEATURES, (F.col("bad") == 1).alias("bad"), grow.alias("grow")))

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict() for r in self.rows.select(*FEATURES, F.col("bad").cast("int").alias("bad")).toLocalIterator())

    def spans(self) -> dict[str, tuple[Spans, Spans]]:
        """Of each feature the intervals of rejected and of all rows that are grown on; few values are intervals of their own."""
        each = self.rows.filter("grow").select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("x")).select("bad", "x.*")
        power = F.when(F.col("v") > 0, F.floor(F.log2("v"))).otherwise(F.lit(0))
        keyed = each.withColumn("power", power).withColumn("part", F.floor(F.col("v") / F.pow(F.lit(2.0), F.col("power")) * INTERVALS))
        mine = F.when(F.col("bad"), F.col("v"))
        found = keyed.groupBy("f", "power", "part").agg(F.min(mine), F.max(mine), F.min("v"), F.max("v")).collect()
        of = lambda f, k: sorted((r[k], r[k + 1]) for r in found if r.f == f and r[k] is not None)
        return {f: (of(f, 3), of(f, 5)) for f in FEATURES}

    def cut(self, tests: _Tests) -> None:
        """Rows that lie between the same cuts are one, with their number."""
        self.tests = tests
        place = lambda f: F.size(F.filter(F.lit(tests.cuts[f]), lambda c: c <= F.col(f))) if tests.cuts[f] else F.lit(0)
        self.placed = checkpointed(self.rows.select("grow", "bad", *[place(f).alias(f) for f in FEATURES]).groupBy("grow", "bad", *FEATURES).agg(F.count("*").alias("n")))

    def _holds(self, rule: Rule) -> Column:
        held = F.lit(True)
        for k in rule:
            over = F.col(self.tests.tests[k].feature) > self.tests.at[k]
            held = held & (over if self.tests.tests[k].over else ~over)
        return held

    def _under(self, rules: list[Rule], gone: list[Rule]) -> DataFrame:
        """The rows that are left, once for each rule that holds, with its number."""
        left = self.placed
        for rule in gone:
            left = left.filter(~self._holds(rule))
        return left.withColumn("rule", F.explode(F.array(*[F.when(self._holds(rule), k) for k, rule in enumerate(rules)]))).filter("rule is not null")

    def by_test(self, rules: list[Rule], gone: list[Rule]) -> list[tuple[np.ndarray, np.ndarray]]:
        each = self._under(rules, gone).filter("grow").select("rule", "bad", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("at")) for f in FEATURES])).alias("x"))
        none = lambda: {f: np.zeros(len(self.tests.cuts[f]) + 1, np.int64) for f in FEATURES}
        counts = [(none(), none()) for _ in rules]
        for r in each.groupBy("rule", "bad", "x.f", "x.at").agg(F.sum("n").alias("n")).collect():
            counts[r.rule][not r.bad][r.f][r["at"]] += r.n
        return [(self.tests.covered(bad), self.tests.covered(good)) for bad, good in counts]

    def by_rule(self, rules: list[Rule], gone: list[Rule]) -> list[tuple[int, int, int, int]]:
        out = np.zeros((len(rules), 4), np.int64)
        for r in self._under(rules, gone).groupBy("rule", "grow", "bad").agg(F.sum("n").alias("n")).collect():
            out[r.rule, 2 * (not r.grow) + (not r.bad)] = r.n
        return [tuple(x) for x in out.tolist()]


def _grow(table: _Rows | _Table, gone: list[Rule]) -> list[Rule]:
    """Conjunctions of PRECISION by a beam search on information gain, those that cover the most rejected rows first."""
    beam, before, best = [()], [None], []
    for _ in range(MOST_TESTS):
        found = []
        for rule, had, (p, n) in zip(beam, before, table.by_test(beam, gone)):
            # of the rows under no test, any feature's first test and its opposite cover all
            p0, n0 = had if had else (int(x[0] + x[_opposite(table.tests, 0)]) for x in (p, n))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p >= LEAST_COVER, p * (np.log2(p / (p + n)) - np.log2(p0 / max(1, p0 + n0))), -1)
            for k in np.argsort(-gain, kind="stable")[:BEAM]:
                if gain[k] > 1e-9:
                    found.append((float(gain[k]), (*rule, int(k)), (int(p[k]), int(n[k]))))
            sure = (p >= LEAST_COVER) & (p >= PRECISION * (p + n))
            at = np.flatnonzero(sure)
            best += [(int(-p[k]), len(rule), (*rule, int(k))) for k in at[np.argsort(-p[at], kind="stable")[:BEAM]]]
        kept = sorted(found, key=lambda x: (-x[0], x[1]))[:BEAM]
        beam, before = [rule for _, rule, _ in kept], [had for *_, had in kept]
        if not beam:
            break
    return [rule for *_, rule in sorted(best)]


def _opposite(tests: _Tests, k: int) -> int:
    t = tests.tests[k]
    return tests.tests.index(Test(t.feature, not t.over, t.cut))


def _first_sure(table: _Rows | _Table, found: list[Rule], gone: list[Rule]) -> Rule | None:
    """The first rule that is of PRECISION on both parts once it is pruned.

    Last tests are dropped while (rejected - kept) / covered doesn't fall on the part that wasn't grown on.
    """
    for start in range(0, len(found), AT_ONCE):
        some = found[start : start + AT_ONCE]
        every = sorted({rule[:k] for rule in some for k in range(1, len(rule) + 1)})
        counts = dict(zip(every, table.by_rule(every, gone)))

        def worth(rule: Rule) -> float:
            q, m = counts[rule][2:]
            return (q - m) / (q + m) if q + m else -1.0

        for rule in some:
            while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
                rule = rule[:-1]
            p, n, q, m = counts[rule]
            if p + q >= PRECISION * (p + q + n + m):
                return rule
    return None


def learn(rows: list[dict] | _Table, seed: int = 5) -> list[list[Test]]:
    """An ordered list of rules that reject, from rows of FEATURES and ``bad`` (0 or 1); the last resort is to keep."""
    table = rows if isinstance(rows, _Table) else _Rows(rows, seed)
    tests = _Tests(table.spans())
    if not tests.tests:
        return []
    table.cut(tests)
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        rule = _first_sure(table, _grow(table, rules), rules)
        if rule is None:
            break
        rules.append(rule)
    return [[tests.tests[k] for k in rule] for rule in rules]


def fit(docs: DataFrame, labels: DataFrame) -> list[list[Test]]:
    """Learn from all labelled ids. Each is one row however often it occurs: its least label, and the least statistics of its texts."""
    known = checkpointed(labels.select("doc_id", F.col("quality").cast("int").alias("q_label")).filter("doc_id is not null and q_label in (0, 1)").groupBy("doc_id").agg(F.min("q_label").alias("q_label")))
    texts = docs.select("doc_id", "text")
    if known.count() <= BROADCAST_IDS:
        counted = with_statistics(texts.join(F.broadcast(known), "doc_id"))
    else:  # numbers are shuffled, not texts
        counted = with_statistics(texts).select("doc_id", *FEATURES).join(known, "doc_id")
    found = counted.select("doc_id", F.struct(*FEATURES, (1 - F.col("q_label")).alias("bad")).alias("q_row"))
    return learn(_Table(found.groupBy("doc_id").agg(F.min("q_row").alias("q_row")).select("doc_id", "q_row.*")))


def verdict(rules: list[list[Test]]) -> Column:
    """The list as an ordered conditional expression over FEATURES: false where a rule fires, else true."""
    out = None
    for rule in rules:
        fires = rule[0].column()
        for test in rule[1:]:
            fires = fires & test.column()
        out = F.when(fires, F.lit(False)) if out is None else out.when(fires, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """``docs`` with statistics, q_base_failed and q_kept."""
    return _unpacked(_judged(docs, rules))


def _judged(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    return statistics(docs).withColumn("q_base_failed", base_failed()).withColumn("q_kept", ~F.col("q_base_failed") & verdict(rules))


def kept_rows(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the list rejects, as they were."""
    return _judged(docs, rules).filter("q_kept").select(*[F.col(f"q_row.`{c}`").alias(c) for c in docs.columns])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``, with rules learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    counts = [F.col(f"q_{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return apply_rules(docs, rules).select("doc_id", *counts)
