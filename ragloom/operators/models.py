"""Pluggable models: the embedding cache (V1, V2), retries (V4), translation (V11), and answers around a model.

A model is a function of a batch: texts in, vectors or answers out. It sees only what no cache has, each text once.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, strip_request
from ..sources.sinks import checkpointed, small_batches
from . import answers

Embed = Callable[[list[str]], list[list[float]]]
Answer = Callable[[list[str]], list[str]]


def cache_key(model: str, text: Column) -> Column:
    """V2."""
    return F.sha1(F.concat(F.lit(f"{model}\n"), text).cast("binary"))


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """V1: rows (key, text) of the distinct texts that the cache (key, vec) lacks."""
    keyed = texts.filter("text is not null").select(cache_key(model, F.col("text")).alias("key"), "text")
    return keyed.groupBy("key").agg(F.min("text").alias("text")).join(cache.select("key"), "key", "left_anti")


class RateLimited(Exception):
    """What a model raises when it asks to be called later."""


@dataclass(frozen=True)
class Retrying:
    """V4: a model that is called again after ``wait * 2 ** n`` seconds while it is rate limited, ``tries`` times at most."""

    model: Callable
    tries: int = 6
    wait: float = 5.0
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, batch: list):
        for n in range(self.tries):
            try:
                return self.model(batch)
            except RateLimited:
                if n == self.tries - 1:
                    raise
                self.sleep(self.wait * 2**n)


def hash_embedder(texts: list[str], size: int = 8) -> list[list[float]]:
    """A stand-in model: unit vectors from a hash of the text."""
    out = []
    for text in texts:
        raw = [b - 127.5 for b in hashlib.sha256(text.encode()).digest()[:size]]
        norm = sum(x * x for x in raw) ** 0.5
        out.append([x / norm for x in raw])
    return out


def embed(misses: DataFrame, model: Embed = hash_embedder, batch: int = 100) -> DataFrame:
    """V1: rows (key, vec) of the misses, ``batch`` texts a call."""
    small_batches(misses.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(model(some.column(1).to_pylist()), pa.list_(pa.float32()))], ["key", "vec"])

    return misses.select("key", "text").mapInArrow(run, "key string, vec array<float>")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with the fresh rows in place of its own of equal key."""
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def stub_answer(prompts: list[str]) -> list[str]:
    """A stand-in model: the first sentence of the prompt's context, cited."""
    return [f"{p.split(chr(10))[-1][:80].strip()} [1]" for p in prompts]


def ask(prompts: DataFrame, model: Answer = stub_answer, out: str = "answer") -> DataFrame:
    """Rows (query_id, answer) without doubled bullets; a failed call gives ``ERROR: ...`` in its row, and the run goes on."""
    small_batches(prompts.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            said = []
            for prompt in part.column(1).to_pylist():
                try:
                    said += model([prompt])
                except Exception as problem:  # the model is anybody's code
                    said.append(f"ERROR: {problem}")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string())], ["query_id", out])

    said = prompts.select(F.col("query_id").cast("long"), "prompt").mapInArrow(run, f"query_id long, {out} string")
    return said.withColumn(out, answers.single_bullets(F.col(out)))


def stub_translate(texts: list[str]) -> list[str]:
    """A stand-in model: the text's words from the last to the first."""
    return [" ".join(reversed(t.split())) for t in texts]


def translate(questions: DataFrame, cache: DataFrame, model: Answer = stub_translate, expand: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of ``questions`` (query_id, text) with translated, the cache (key, en) after it).

    Each distinct text that the cache lacks is translated once. Expanded translations have keys of their own.
    """
    small_batches(questions.sparkSession)
    key = F.concat(F.lit("expand|" if expand else ""), "text")
    keyed = questions.withColumn("key", key)
    misses = keyed.filter("text is not null").select("key", "text").distinct().join(cache.select("key"), "key", "left_anti")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.strip() for t in model(part.column(1).to_pylist())], pa.string())], ["key", "en"])

    fresh = checkpointed(misses.mapInArrow(run, "key string, en string"))
    known = cache.select("key", "en").unionByName(fresh)
    return keyed.join(known.withColumnRenamed("en", "translated"), "key", "left").drop("key"), known


@dataclass(frozen=True)
class Rules:
    """Patterns, messages and prompt rules of ``run``. Templates have one %s."""

    refusal: str
    notice: str
    request: str
    asks_diagnosis: str
    stated: str
    conditions: str
    diagnosis: str
    advice: str
    references: str
    diagnosis_rule: str = "Don't judge the person's values."
    ask_back_rule: str = "First ask for the conditions that are missing."
    outside_rule: str = "Give no advice on %s."
    again_rule: str = "The last answer had: %s. Write it without that."
    sentence_ends: str = answers.ENDS


Search = Callable[[DataFrame], DataFrame]
#: Of an answer's candidate sentences, a line each, the one that breaks the rule; None or "" if none does.
Judge = Callable[[str], str | None]


def judged(rows: DataFrame, rules: Rules, judge: Judge | None, answer: str, out: str) -> DataFrame:
    """``rows`` (query_id, ...) with ``out``: the sentence of ``answer`` that advises, null if none does.

    Only answers with candidate sentences go to the judge; one that fails has said nothing. Without a judge the first
    candidate counts.
    """
    found = answers.candidates(F.col(answer), rules.advice, rules.references, rules.sentence_ends)
    if judge is None:
        return rows.withColumn(out, F.get(found, F.lit(0)))
    small_batches(rows.sparkSession)

    def run_(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            said = []
            for sentences in part.column(1).to_pylist():
                try:
                    said.append(judge(sentences) or None)
                except Exception:  # the judge is anybody's code
                    said.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string())], ["query_id", out])

    asked = rows.select("query_id", F.array_join(F.transform(found, strip), "\n").alias("sentences")).filter("sentences <> ''")
    # written, so that the judge is asked once
    verdicts = checkpointed(asked.mapInArrow(run_, f"query_id long, {out} string"))
    return rows.join(verdicts, "query_id", "left")


def run(questions: DataFrame, rules: Rules, search: Search, model: Answer = stub_answer, translations: DataFrame | None = None, translator: Answer = stub_translate, judge: Judge | None = None) -> DataFrame:
    """Rows (query_id, scope, asked, searched, translated, diagnosis, answer, sources) of questions (query_id, question, scope, out_of_scope, rewritten).

    Out of scope: a refusal, without search and model. In part: the rewritten question is asked, if there is one, and
    a notice follows. The search text lacks the generic request; its translation (with a cache (key, en) in
    ``translations``) is searched too. ``search``: rows (query_id, text, translated) to rows (query_id, rank, cite, score,
    text). An answer that advises, by its candidate sentences or by what ``judge`` says of them, or that judges is asked
    for once more with the sentence named; what is still there goes.
    """
    outside = questions.filter("scope = 'out'")
    none = F.lit(None).cast("string")
    refused = outside.select("query_id", "scope", none.alias("asked"), none.alias("searched"), none.alias("translated"), F.lit(False).alias("diagnosis"), answers.refusal(F.col("out_of_scope"), rules.refusal).alias("answer"), F.lit("").alias("sources"))
    part = F.col("scope") == "partial"
    asked = F.when(part & (strip(F.coalesce("rewritten", F.lit(""))) != ""), strip(F.col("rewritten"))).otherwise(F.col("question"))
    inside = questions.filter("scope <> 'out'").withColumn("asked", asked).withColumn("text", strip_request(F.col("asked"), rules.request))
    if translations is None:
        inside = inside.withColumn("translated", none)
    else:
        inside, _ = translate(inside, translations, translator)
    inside = checkpointed(inside)
    found = checkpointed(search(inside.select("query_id", "text", "translated")))
    line = F.format_string("[%d] %s (%.2f)", F.col("rank"), F.col("cite"), F.col("score"))
    listed = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("sources"))
    diagnosis = F.col("question").rlike(rules.asks_diagnosis)
    topics = F.array_join("out_of_scope", ", ")
    extra = F.concat_ws("\n", F.when(diagnosis, F.lit(rules.diagnosis_rule)), F.when(answers.ask_back(F.col("question"), rules.asks_diagnosis, rules.stated, rules.conditions), F.lit(rules.ask_back_rule)), F.when(part, F.format_string(rules.outside_rule, topics)))
    rows = inside.join(answers.context(found), "query_id", "left").join(listed, "query_id", "left").withColumns({"diagnosis": diagnosis, "extra": extra})
    prompt = F.concat_ws("\n", "extra", "asked", F.coalesce("context", F.lit("")))
    # written, so that the model is asked once
    rows = checkpointed(rows.join(ask(rows.select("query_id", prompt.alias("prompt")), model), "query_id"))
    rows = _rewritten(judged(rows, rules, judge, "answer", "hit"), rules.advice, rules, model, judge)
    banned = F.when(F.col("diagnosis") & answers.banned(F.col("answer"), rules.diagnosis, rules.references), F.regexp_extract(answers.body(F.col("answer"), rules.references), rules.diagnosis, 0))
    rows = _rewritten(rows.withColumn("hit", banned), rules.diagnosis, rules, model)
    final = F.when(part, F.concat("answer", F.lit("\n\n"), F.format_string(rules.notice, topics))).otherwise(F.col("answer"))
    done = rows.select("query_id", "scope", "asked", F.col("text").alias("searched"), "translated", "diagnosis", final.alias("answer"), F.coalesce("sources", F.lit("")).alias("sources"))
    return refused.unionByName(done)


def _rewritten(rows: DataFrame, pattern: str, rules: Rules, model: Answer, judge: Judge | None = None) -> DataFrame:
    """``rows`` where answers with a ``hit`` are asked for once more, and lose what still matches: the sentence that the judge names, or all of the pattern."""
    marked = checkpointed(rows)
    named = F.format_string(rules.again_rule, F.substring("hit", 1, 60))
    again = checkpointed(ask(marked.filter("hit is not null").select("query_id", F.concat_ws("\n", "extra", named, "asked", F.coalesce("context", F.lit(""))).alias("prompt")), model, "retried"))
    if judge:
        told = judged(again, rules, judge, "retried", "still")
        clean = F.when(F.col("still").isNotNull(), answers.drop_sentences(F.col("retried"), F.substring(F.trim("still"), 1, 40), rules.references, rules.sentence_ends)).otherwise(F.col("retried"))
    else:
        told = again
        clean = F.when(answers.banned(F.col("retried"), pattern, rules.references), answers.drop_sentences(F.col("retried"), pattern, rules.references, rules.sentence_ends)).otherwise(F.col("retried"))
    both = marked.join(told.select("query_id", clean.alias("clean")), "query_id", "left")
    return both.withColumn("answer", F.coalesce("clean", "answer")).drop("hit", "clean")


def baseline(questions: DataFrame, model: Answer = stub_answer) -> DataFrame:
    """Rows (query_id, answer) of questions (query_id, question) asked without any retrieval."""
    return ask(questions.select("query_id", F.col("question").alias("prompt")), model)


GRADING = ["points", "sources_marked", "asked_back", "violations", "memo"]


def report(done: DataFrame, name: str, setting: Column) -> DataFrame:
    """A run's rows with the model's name, the setting, whether the call failed, and blank columns for grading."""
    rows = done.withColumns({"model": F.lit(name), "setting": setting, "failed": F.col("answer").startswith("ERROR")})
    return rows.withColumns({c: F.lit("") for c in GRADING})
