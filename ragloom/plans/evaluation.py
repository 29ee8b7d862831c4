"""M5, M6, M8, M9: retrieval and answer evaluation, grading, snapshots and caches.

Questions are the vectors of ids divisible by 20; answers are the assistant's turns of ``conversations``, with
citations and marks put in by rules on their ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, models, repro, retrieval, vector
from ..sources import tables
from .vector import _SCORED, _stage

SPEC = "concat('src', query_id % 20, ':', query_id % 7, '-', query_id % 7 + 2, ',', query_id % 9, ',x; src', (query_id + 3) % 20, CASE WHEN query_id % 40 = 0 THEN '; src5:2\n src6 ; src5:1' ELSE ';' END)"
TERMS, STAGES, DISEASES = "th(e|er)\\b", "^anti", "hand|rest|tion"
REFERENCES, BANNED, ADJUST = "References:", "(the|of) th", "an[a-z]* to"
REFUSAL, ASK = "won.t answer|will not answer", "let me know|please check"
ASK_FOR = "\\s*(please )?(help|answer)( me)?[.?]?\\s*$"


def _questions(spark, d):
    return tables.queries(spark, d).select("query_id", F.expr(SPEC).alias("spec"))


def gold_parse(spark, d):
    """Q1, over a spec for each vector."""
    rows = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id")).select("query_id", F.expr(SPEC).alias("spec"))
    return retrieval.gold(rows).select("query_id", "doc", F.array_join("pages", ",").alias("pages"))


def label_pages(spark, d):
    """Q2, over labels made of document ids."""
    label = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(doc_id, '-', doc_id + 2) WHEN 1 THEN source WHEN 2 THEN concat(' ', doc_id) ELSE concat(doc_id, '-', doc_id - 5) END")
    return tables.table(spark, d, "documents").select("doc_id", F.array_join(retrieval.label_pages(label), ",").alias("pages"))


def _pages(column):
    return F.array((F.col(column) % 10).cast("int"))


def _marked(spark, d):
    scored = vector.best_scores(tables.chunks(spark, d), tables.queries(spark, d), [vector.Limit("score", 10), *vector.quota_limits()])
    found = vector.topk(scored, 10).withColumn("strategy", F.lit("fused")).unionByName(vector.quota_topk(scored).withColumn("strategy", F.lit("quota")))
    placed = found.withColumn("pages", _pages("chunk_id")).withColumn("label", (F.col("chunk_id") % 10).cast("string"))
    return retrieval.marked_hits(placed, retrieval.gold(_questions(spark, d)))


def retrieval_hits(spark, d):
    """Q3."""
    return _marked(spark, d).select("strategy", "query_id", F.col("rank").cast("long").alias("rank"), "doc_hit", "page_hit")


def _reach(spark, d):
    chunks = tables.chunks(spark, d).withColumn("pages", _pages("chunk_id"))
    return retrieval.reachable(chunks, retrieval.gold(_questions(spark, d)))


def retrieval_reachability(spark, d):
    """Q4."""
    return _reach(spark, d)


def retrieval_first_rank(spark, d):
    """Q5."""
    return retrieval.query_metrics(_marked(spark, d)).select("strategy", "query_id", "doc_hit", "page_hit", F.col("first_rank").cast("long").alias("first_rank"), "n_academic", "top")


def retrieval_strategy_summary(spark, d):
    """Q6."""
    return retrieval.strategy_summary(retrieval.query_metrics(_marked(spark, d)), _reach(spark, d))


def _turns(spark, d):
    return tables.table(spark, d, "conversations")


def query_strip_suffix(spark, d):
    """V10, over the user's turns with a request put at the end of some."""
    asked = F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" please help me?"))).when(F.col("conv_id") % 5 == 0, F.lit("help me")).otherwise(F.col("text"))
    return _turns(spark, d).filter("role = 'user'").select("conv_id", "turn", T.strip_request(asked, ASK_FOR).alias("question"))


def citation_string(spark, d):
    """V12."""
    rows = tables.table(spark, d, "documents").selectExpr("doc_id", "source", "CASE doc_id % 3 WHEN 0 THEN '12' WHEN 1 THEN '12-14' ELSE 'part' END AS label", "doc_id % 5 = 0 AS ocr")
    return rows.select("doc_id", retrieval.citation(F.lit("public"), F.lit("t"), F.col("source"), F.col("label"), F.col("ocr")).alias("cite"))


def setting_label_codec(spark, d):
    """Labels of settings made of ids, and what they parse to."""
    rows = tables.table(spark, d, "embeddings").select("vec_id", retrieval.setting_label(F.lit("fixed"), F.col("vec_id") % 12, F.col("vec_id") % 3, F.col("vec_id") % 4, F.lit(None).cast("long"), F.col("vec_id") % 2 == 0).alias("label"))
    return rows.select("vec_id", "label", retrieval.setting_parts(F.col("label")).alias("p")).select("vec_id", "label", "p.k", "p.per_doc", "p.public", "p.public_per_doc", "p.translated")


def scope_override_rules(spark, d):
    """R1."""
    rows = _turns(spark, d).selectExpr("conv_id", "turn", "text", "CASE conv_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'out' WHEN 2 THEN 'partial' ELSE 'what' END AS scope", "CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN array('anti x', 'bone') ELSE array('the th') END AS outside")
    rule = answers.scope_rules(F.col("text"), F.col("scope"), F.col("outside"), TERMS, STAGES, DISEASES)
    return rows.select("conv_id", "turn", rule.alias("r")).select("conv_id", "turn", F.col("r.scope").alias("scope"), F.array_join("r.out_of_scope", ",").alias("items"))


def context_assembly(spark, d):
    """Each conversation's turns as its context."""
    rows = _turns(spark, d).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("cite"), "text")
    return answers.context(rows).select("query_id", F.length("context").cast("long").alias("n"), F.md5(F.col("context").cast("binary")).alias("h"))


def answer_refusal(spark, d):
    """A2."""
    said = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" I won't answer that."))).otherwise(F.col("text"))
    return _turns(spark, d).filter("role = 'assistant'").select("conv_id", "turn", answers.applies(F.col("turn") % 2 == 1, said.rlike(REFUSAL)).alias("refused"))


def answer_askback(spark, d):
    """A6, R6."""
    said = F.when(F.col("conv_id") % 4 == 0, F.concat("text", F.lit(" Please let me know."))).otherwise(F.col("text"))
    return _turns(spark, d).filter("role = 'assistant'").select("conv_id", "turn", answers.applies(F.col("conv_id") % 2 == 0, said.rlike(ASK)).alias("asked"), answers.ask_back(F.col("text"), "which th", "medic", "[0-9]").alias("must_ask"))


def _cited(spark, d):
    said = F.concat("text", F.expr("CASE WHEN conv_id % 3 = 0 THEN concat(' [', turn % 4, '][2] and [', conv_id % 7, ']') ELSE '' END"))
    sources = F.expr("CASE WHEN conv_id % 5 = 4 THEN '' ELSE concat('[1] [x] t (src', conv_id % 20, ') 3 (0.51)\n[2] [x] t (src', turn % 20, ') 4 (0.50)\nno line\n[3] [x] t (s-3) 4 (0.4)') END")
    rows = _turns(spark, d).filter("role = 'assistant'").select("conv_id", "turn", "text", answers.cited(said).alias("numbers"), answers.source_docs(sources).alias("sources"))
    return rows.withColumn("verifiable", answers.verifiable(F.col("numbers"), F.col("sources"), F.col("conv_id") % 6 != 5)).withColumn("gold", answers.gold_cited(F.col("numbers"), F.col("sources"), F.array(F.lit("src1"), F.lit("src3"), F.lit("s-3"))))


def answer_cited_numbers(spark, d):
    """A11."""
    return _cited(spark, d).select("conv_id", "turn", F.array_join("numbers", ",").alias("numbers"), F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["rank"], s["doc"])), ",").alias("sources"))


def answer_verifiable_sources(spark, d):
    """A7, A8."""
    return _cited(spark, d).select("conv_id", "turn", "verifiable")


def answer_gold_cited(spark, d):
    """A9."""
    return _cited(spark, d).select("conv_id", "turn", "gold")


def answer_check_matrix(spark, d):
    """A10."""
    rows = _cited(spark, d).withColumn("banned", answers.banned(F.col("text"), BANNED, REFERENCES)).withColumn("result", F.concat(F.lit("run"), (F.col("conv_id") % 3).cast("string")))
    return answers.check_matrix(rows, "result", ["verifiable", "gold", "banned"])


def _with_references(name="text"):
    return F.concat(name, F.when(F.col("turn") % 2 == 1, F.lit("\n\nReferences:\nof the th. an to")).otherwise(F.lit("")))


def guard_banned_expression(spark, d):
    """R8, R7."""
    said = _with_references()
    return _turns(spark, d).select("conv_id", "turn", answers.banned(said, BANNED, REFERENCES).alias("banned"), F.size(answers.candidates(said, ADJUST, REFERENCES)).cast("long").alias("candidates"))


def guard_drop_sentences(spark, d):
    """R9."""
    return _turns(spark, d).select("conv_id", "turn", F.md5(answers.drop_sentences(_with_references(), "th[a-z]* th", REFERENCES).cast("binary")).alias("h"))


def expected_scope(spark, d):
    """A1."""
    rows = _turns(spark, d).selectExpr("conv_id", "turn", "CASE turn % 3 WHEN 0 THEN ' in, partial' WHEN 1 THEN '' END AS explicit", "CASE conv_id % 3 WHEN 0 THEN 'out of scope' WHEN 1 THEN 'partly in scope' ELSE 'other' END AS kind")
    return rows.select("conv_id", "turn", F.array_join(answers.expected_scopes(F.col("explicit"), F.col("kind")), ",").alias("scopes"))


def fingerprint(spark, d):
    """Z1."""
    return tables.table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("h"))


def snapshot_diff(spark, d):
    """Z3: labels before and after every ninth changes, every tenth goes and every eleventh comes."""
    rows = tables.table(spark, d, "labels").select("doc_id", F.concat(F.lit("labels > "), F.col("doc_id").cast("string")).alias("path"), F.col("quality").cast("string").alias("value"))
    new = rows.filter("doc_id % 10 <> 0").withColumn("value", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("value")))
    return repro.snapshot_diff(rows.filter("doc_id % 11 <> 0"), new)


def grading_rubric_split(spark, d):
    """A text's sentences as points."""
    points = F.replace("text", F.lit(". "), F.lit(" / "))
    return tables.table(spark, d, "documents").select("doc_id", repro.rubric(points).alias("r")).select("doc_id", F.col("r.judgement").alias("judgement"), F.size("r.details").cast("long").alias("details"), F.array_join("r.details", "|").alias("joined"))


def _sheets(spark, d):
    sheet = F.expr("concat('[', CASE conv_id % 5 WHEN 0 THEN 'O' WHEN 1 THEN '△' WHEN 2 THEN ' ' WHEN 3 THEN ' X ' ELSE '0.5' END, '] judgement\r\n  [', CASE turn % 3 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE '○' END, '] 1. detail\r\nnot a box [O]\r\nviolations: ', CASE WHEN turn % 2 = 0 THEN cast(turn AS string) ELSE '' END, ' times')")
    return _turns(spark, d).select("conv_id", "turn", sheet.alias("sheet"))


def grading_sheet_parse(spark, d):
    """G6."""
    rows = _sheets(spark, d).select("conv_id", "turn", F.posexplode(repro.marks(F.col("sheet"))).alias("no", "m"), repro.violations(F.col("sheet"), "violations").alias("violations"))
    return rows.select("conv_id", "turn", F.col("no").cast("long").alias("no"), "m.mark", "m.rest", F.col("violations").cast("long").alias("violations"))


def grading_score_report(spark, d):
    """G7."""
    rows = _sheets(spark, d).select(F.concat(F.lit("sheet"), (F.col("conv_id") % 4).cast("string")).alias("sheet_id"), F.posexplode(repro.marks(F.col("sheet"))).alias("no", "m"))
    return repro.score_report(rows.select("sheet_id", F.when(F.col("no") == 0, "judgement").otherwise("detail").alias("kind"), "m.mark"), "sheet_id")


def embed_cache_misses(spark, d):
    """V1, V2: turns of conversations not divisible by 3 against a cache of the others."""
    turns = _turns(spark, d)
    cache = turns.filter("conv_id % 3 = 0").select(models.cache_key("m1", F.col("text")).alias("key"))
    return models.cache_misses(turns, cache, "m1")


def embed_cache_upsert(spark, d):
    """Keys of the cache after the misses are embedded; vectors by the stand-in model."""
    turns = _turns(spark, d)
    cache = models.embed(turns.filter("conv_id % 3 = 0").select(models.cache_key("m1", F.col("text")).alias("key"), "text").dropDuplicates(["key"]))
    fresh = models.embed(models.cache_misses(turns, cache, "m1"))
    return models.cache_upsert(cache, fresh).select("key", F.size("vec").cast("long").alias("n"))


RULES = models.Rules("I won't answer questions on %s.", "Questions on %s are left out.", ASK_FOR, "which th", "medic", "[0-9]", BANNED, ADJUST, REFERENCES)


def answer_pipeline_stub(spark, d):
    """R10, R11 with the stand-in models: first user turns as questions, each conversation's other turns as what is found."""
    turns = _turns(spark, d)
    questions = turns.filter("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min(F.struct("turn", "text")).alias("q")).select("query_id", F.col("q.text").alias("question"))
    ruled = questions.withColumn("r", answers.scope_rules(F.col("question"), F.when(F.col("query_id") % 3 == 0, "out").otherwise("in"), F.array(F.lit("bones")), TERMS, STAGES, DISEASES)).select("query_id", "question", "r.scope", "r.out_of_scope", F.when(F.col("query_id") % 2 == 0, F.concat("question", F.lit(" only the rest"))).alias("rewritten"))
    found = turns.filter("role <> 'user'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("cite"), F.lit(0.5).alias("score"), "text")
    cache = spark.createDataFrame([], "key string, en string")
    done = models.run(ruled, RULES, lambda asked: found.join(asked.select("query_id"), "query_id", "left_semi"), translations=cache)
    return models.report(done, "stand-in", F.lit("fixed@10"))


def answer_baseline(spark, d):
    """R12 with the stand-in model."""
    turns = _turns(spark, d).filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return models.baseline(turns)


def query_translation_cache(spark, d):
    """User turns against a cache of those of conversations divisible by 3, plainly and expanded."""
    turns = _turns(spark, d).filter("role = 'user'").select("conv_id", "turn", "text")
    cache = turns.filter("conv_id % 3 = 0").select(F.col("text").alias("key"), F.lit("known").alias("en")).distinct()
    plain, known = models.translate(turns, cache)
    expanded, _ = models.translate(turns, known, expand=True)
    return plain.withColumn("expand", F.lit(False)).unionByName(expanded.withColumn("expand", F.lit(True))).select("conv_id", "turn", "expand", "translated")


def answer_scope_right(spark, d):
    """A3."""
    rows = _turns(spark, d).selectExpr("conv_id", "turn", "concat(CASE turn % 4 WHEN 0 THEN 'in' WHEN 1 THEN ' partial ' ELSE 'out' END, ': why: so') AS verdict", "CASE turn % 3 WHEN 0 THEN ' in, partial' WHEN 1 THEN '' END AS explicit", "CASE conv_id % 3 WHEN 0 THEN 'out of scope' WHEN 1 THEN 'partly in scope' ELSE 'other' END AS kind")
    return rows.select("conv_id", "turn", answers.scope_right(F.col("verdict"), F.col("explicit"), F.col("kind")).alias("right"))


def answer_auto_checks(spark, d):
    """Cited numbers against three chunks, of which the second is academic."""
    said = F.concat("text", F.expr("CASE WHEN conv_id % 3 = 0 THEN concat(' [', turn % 5, '][2] and [', conv_id % 7, ']?') ELSE '' END"))
    chunks = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit("academic" if k == 2 else "public").alias("doc_type")) for k in (1, 2, 3)])
    checks = answers.auto_checks(said, chunks, ["the", "ing", "zq"], "\\?|let me know", "doctor|clinic|on")
    return _turns(spark, d).select("conv_id", "turn", checks.alias("c")).select("conv_id", "turn", F.col("c.n_parts").cast("long").alias("n_parts"), F.array_join("c.cited", ",").alias("cited"), F.array_join("c.invalid", ",").alias("invalid"), F.col("c.n_academic").cast("long").alias("n_academic"), "c.asks", "c.refers")


def answer_gold_found(spark, d):
    """Gold documents among the ten best."""
    best = vector.topk(vector.best_scores(tables.chunks(spark, d), tables.queries(spark, d), [vector.Limit("score", 10)]), 10).groupBy("query_id").agg(F.collect_set("doc").alias("docs"))
    gold = retrieval.gold(_questions(spark, d)).groupBy("query_id").agg(F.collect_set("doc").alias("gold"))
    return gold.join(best, "query_id").select("query_id", F.array_join(answers.gold_found(F.col("gold"), F.col("docs")), ",").alias("found"), F.size("gold").cast("long").alias("n_gold"))


WORDS = answers.Vocabulary(REFUSAL, ASK, "which th", BANNED, ADJUST, REFERENCES)


def answer_checks_joined(spark, d):
    """A2 to A10: assistant turns as results of two runs, one without retrieval, joined to their conversations as questions."""
    turns = _turns(spark, d)
    kind = "CASE conv_id % 4 WHEN 0 THEN 'out of scope' WHEN 1 THEN 'partly in scope' WHEN 2 THEN 'missing conditions' ELSE 'other' END"
    questions = turns.groupBy(F.col("conv_id").alias("number")).agg(F.min(F.struct("turn", "text")).alias("q")).selectExpr("number", kind.replace("conv_id", "number") + " AS kind", "CASE WHEN number % 5 = 0 THEN 'in,partial' ELSE '' END AS explicit", "q.text AS question", "CASE WHEN number % 2 = 0 THEN array('src1', 's-3') ELSE array() END AS gold")
    said = "concat(text, CASE WHEN conv_id % 3 = 0 THEN concat(' I will not answer. Please check [1][', turn % 5, ']') ELSE '' END)"
    results = turns.filter("role = 'assistant'").selectExpr("CASE WHEN turn % 4 = 1 THEN 'blank' ELSE 'full' END AS result", "conv_id AS number", "turn", f"{said} AS answer", "CASE WHEN turn % 4 <> 1 THEN concat(CASE WHEN conv_id % 2 = 0 THEN 'in' ELSE 'out' END, ': so') END AS verdict", "CASE WHEN turn % 4 <> 1 THEN concat('[1] t (src', conv_id % 4, ') 3 (0.51)\n[2] t (s-3) 4 (0.50)') END AS sources")
    checks = answers.check_answers(results, questions, WORDS)
    return answers.check_matrix(checks, "result", answers.CHECKS)


def strategy_grid(spark, d):
    """Q8: two strategies, the even and the odd chunks, each searched for all questions."""
    index = tables.chunks(spark, d).withColumn("strategy", F.when(F.col("chunk_id") % 2 == 0, "even").otherwise("odd"))
    found = retrieval.strategy_grid(index, tables.queries(spark, d), lambda chunks, asked: vector.topk(vector.best_scores(chunks, asked, [vector.Limit("score", 3)]), 3), suffix=retrieval.setting_suffix(per_doc=2, translated=True))
    return found.select("strategy", "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def grading_width(spark, d):
    """G1, on texts with Hangul and full forms put in, and a character of known width: a watch, lightning, an angle, Tangut, an accent, a half, a half form."""
    known = F.element_at(F.split(F.lit("⌚,⚡,〈,𗀀,é,½,ｱ"), ","), (F.col("doc_id") % 7 + 1).cast("int"))
    odd = F.concat("text", F.repeat(F.lit("가ｱ（○"), (F.col("doc_id") % 5).cast("int")), F.repeat(known, 3))
    return tables.table(spark, d, "documents").select("doc_id", repro.display_width(odd).cast("long").alias("width"))


def grading_cited_texts(spark, d):
    """Stored lists of three sources; in every third conversation the search gives another one, in every fifth a mark is new."""
    turns = _turns(spark, d).filter("role = 'user' and turn = 0 or turn = 1")
    stored = turns.groupBy(F.col("conv_id").alias("number")).agg(F.max("text").alias("t")).select("number", F.expr("concat('so [2] and [', number % 4, ']')").alias("answer"), F.expr("concat('[1] a (d', number, ') 3쪽 (0.51)\n\n[2] b (e) 4 [OCR] (0.40)\n[3] c (f) part (0.31)')").alias("sources"))
    found = stored.select("number", F.posexplode(F.array(F.expr("concat('a (d', number, ') 3쪽')"), F.expr("concat('b (e) 4', CASE WHEN number % 5 = 0 THEN '' ELSE ' [OCR]' END)"), F.expr("CASE WHEN number % 3 = 0 THEN 'x (f) part' ELSE 'c (f) part' END"))).alias("k", "cite")).select("number", (F.col("k") + 1).alias("rank"), "cite", F.concat(F.lit("text "), (F.col("k") + 1).cast("string")).alias("text"))
    return repro.cited_texts(stored, found).select("number", F.col("rank").cast("long").alias("rank"), "text", "cited")


def _questions_to_grade(spark, d):
    turns = _turns(spark, d).groupBy(F.col("conv_id").alias("number")).agg(F.min(F.struct("turn", "text")).alias("q"), F.max(F.struct("turn", "text")).alias("a"))
    rows = turns.selectExpr("number", "concat('kind ', number % 3) AS kind", "q.text AS question", "CASE WHEN number % 4 <> 0 THEN concat(CASE WHEN number % 2 = 0 THEN 'in' ELSE 'out' END, ': so') END AS verdict", "array('in', 'partial') AS expected", "a.text AS answer", "'a judgement' AS judgement", "CASE WHEN number % 3 = 0 THEN array() ELSE array('one', 'two') END AS details")
    texts = turns.filter("number % 4 <> 0").selectExpr("number", "explode(array(1, 2)) AS rank").selectExpr("number", "rank", "concat('source ', rank, ' \n of it') AS text", "rank = 1 AS cited")
    return rows, texts


def grading_sheet_lines(spark, d):
    """A sheet of all conversations."""
    rows, texts = _questions_to_grade(spark, d)
    return repro.sheet_lines(rows, texts, "grading sheet").select("part", F.col("line_no").cast("long").alias("line_no"), "line")


def grading_sheet_blocks(spark, d):
    """A filled sheet for each twenty conversations, parsed: ids divisible by 5 have everything right, by 3 an empty judgement."""
    part = "concat('====\n', conv_id, '번 · kind\n====\n[scope] ', CASE WHEN conv_id % 2 = 0 THEN 'O' ELSE 'X' END, '\n  [', CASE WHEN conv_id % 3 = 0 THEN ' ' WHEN conv_id % 5 = 0 THEN 'O' ELSE ' X ' END, '] judgement yes\n  [△] 1. one\n  [', CASE WHEN conv_id % 5 = 0 THEN '○' ELSE '' END, '] 2. two\n  [x] [1] cited\n  [O] [2] cited\n  [', CASE WHEN conv_id % 7 = 0 THEN 'o' ELSE '' END, '] retrieval hit\n  violations: ', CASE WHEN conv_id % 2 = 0 THEN cast(conv_id % 4 AS string) ELSE '' END, '\n')"
    blocks = _turns(spark, d).filter("turn = 0").selectExpr("conv_id", f"{part} AS block")
    sheets = blocks.groupBy(F.floor(F.col("conv_id") / 20).alias("sheet_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "block"))), lambda x: x["block"]), "").alias("body")).select("sheet_id", F.concat(F.lit("head\n"), "body", F.lit("====\nlist\n")).alias("text"))
    found = repro.parse_sheet(sheets)
    return found.select("number", "judgement", "detail_score", *[F.col(c).cast("long").alias(c) for c in ("details_graded", "details", "cites_right", "cites_graded", "cites", "violations")], "hit", "scope")


SETTINGS = {"model": {"answers": "m", "temperature": 0}, "search": {"strategy": "fixed", "k": 10, "text:request": ASK_FOR}, "rules": {"text:terms": TERMS, "text:stages": STAGES}}


def snapshot_settings(spark, d):
    """Settings, and the documents as files."""
    files = tables.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return repro.snapshot(spark, SETTINGS, files)


def grading_sheet_report(spark, d):
    """The report of the sheets of ``grading_sheet_blocks``' kind, a sheet for each twenty conversations: all are graded but some judgements."""
    part = F.concat(F.lit("====\n"), F.col("conv_id").cast("string"), F.lit("번 · kind\n====\n[scope] "), F.when(F.col("conv_id") % 2 == 0, "O").otherwise("X"), F.lit("\n["), F.when(F.col("conv_id") % 3 == 0, " ").otherwise("O"), F.lit("] judgement yes\n[△] 1. a\n[O] [2] c\n["), F.when(F.col("n_chars") > 300, "X").otherwise("O"), F.lit("] [3] d\n[O] retrieval hit\nviolations: "), (F.col("n_chars") % 3).cast("string"), F.lit("\n"))
    convs = _turns(spark, d).groupBy("conv_id").agg(F.sum(F.length("text")).alias("n_chars"))
    sheets = convs.groupBy(F.floor(F.col("conv_id") / 20).alias("sheet_id")).agg(F.array_join(F.array_sort(F.collect_list(part)), "").alias("text"))
    return repro.sheet_report(repro.parse_sheet(sheets.select("sheet_id", F.concat(F.lit("head\n"), "text").alias("text"))))


QUERIES = {
    f.__name__: f
    for f in (gold_parse, label_pages, retrieval_hits, retrieval_reachability, retrieval_first_rank, retrieval_strategy_summary, query_strip_suffix, citation_string, setting_label_codec, scope_override_rules, context_assembly, answer_refusal, answer_askback, answer_cited_numbers, answer_verifiable_sources, answer_gold_cited, answer_check_matrix, guard_banned_expression, guard_drop_sentences, expected_scope, fingerprint, snapshot_diff, grading_rubric_split, grading_sheet_parse, grading_score_report, embed_cache_misses, embed_cache_upsert, answer_pipeline_stub, answer_baseline, query_translation_cache, answer_scope_right, answer_auto_checks, answer_gold_found, answer_checks_joined, strategy_grid, grading_width, grading_cited_texts, grading_sheet_lines, grading_sheet_blocks, snapshot_settings, grading_sheet_report)
}

_SPEC = SPEC.replace("\n", "' || chr(10) || '")


def _gold(rows: str) -> str:
    return f"""specs AS ({rows}),
parts AS (SELECT query_id, trim(unnest(regexp_split_to_array({_SPEC}, '[;' || chr(10) || ']'))) AS part FROM specs),
named AS (SELECT query_id, trim(split_part(part, ':', 1)) AS doc, CASE WHEN contains(part, ':') THEN split_part(part, ':', 2) ELSE '' END AS spec FROM parts WHERE part <> ''),
tokens AS (SELECT query_id, doc, trim(unnest(string_split(spec, ','))) AS p FROM named),
numbers AS (SELECT query_id, doc, unnest(range(split_part(p, '-', 1)::BIGINT, coalesce(nullif(split_part(p, '-', 2), ''), split_part(p, '-', 1))::BIGINT + 1)) AS page FROM tokens WHERE regexp_matches(p, '^[0-9]+(-[0-9]+)?$')),
gold AS (SELECT n.query_id, n.doc, coalesce(list(DISTINCT page ORDER BY page) FILTER (page IS NOT NULL), []) AS pages FROM (SELECT DISTINCT query_id, doc FROM named) n LEFT JOIN numbers USING (query_id, doc) GROUP BY 1, 2)"""


_MARKED = (
    _SCORED
    + _stage(0, "doc_type = 'public'", "original", "5", 1)
    + _stage(1, "TRUE", "fused", "10", 2)
    + f""",
found AS (
  SELECT 'fused' AS strategy, query_id, chunk_id, doc, doc_type, fused AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM s0) WHERE rank <= 10
  UNION ALL SELECT 'quota', query_id, chunk_id, doc, doc_type, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) FROM s2 WHERE picked),
{_gold("SELECT query_id FROM queries")},
marked AS (SELECT f.*, g.doc IS NOT NULL AS doc_hit, g.doc IS NOT NULL AND (len(g.pages) = 0 OR list_contains(g.pages, chunk_id % 10)) AS page_hit FROM found f LEFT JOIN gold g ON f.query_id = g.query_id AND f.doc = g.doc),
reach AS (SELECT g.query_id, coalesce(bool_or(c.chunk_id IS NOT NULL AND (len(g.pages) = 0 OR list_contains(g.pages, c.chunk_id % 10))), FALSE) AS reachable FROM gold g LEFT JOIN chunks c ON c.doc = g.doc GROUP BY 1),
metrics AS (SELECT strategy, query_id, bool_or(doc_hit) AS doc_hit, bool_or(page_hit) AS page_hit, min(CASE WHEN page_hit THEN rank END) AS first_rank, count_if(doc_type = 'academic')::BIGINT AS n_academic,
  string_agg(doc || ':' || chunk_id % 10 || '(' || printf('%.2f', score) || ')', ' / ' ORDER BY rank) AS top FROM marked GROUP BY 1, 2)
"""
)
_CITED = """
WITH said AS (SELECT conv_id, turn, text,
  list_sort(list_distinct(list_transform(regexp_extract_all(text || CASE WHEN conv_id % 3 = 0 THEN ' [' || turn % 4 || '][2] and [' || conv_id % 7 || ']' ELSE '' END, '\\[(\\d{1,9})\\]', 1), lambda x: x::INT))) AS numbers,
  CASE WHEN conv_id % 5 = 4 THEN [] ELSE [{'rank': 1, 'doc': 'src' || conv_id % 20}, {'rank': 2, 'doc': 'src' || turn % 20}, {'rank': 3, 'doc': 's-3'}] END AS sources
  FROM conversations WHERE role = 'assistant'),
checks AS (SELECT *,
  CASE WHEN conv_id % 6 = 5 THEN FALSE WHEN len(sources) > 0 THEN len(numbers) > 0 AND len(list_filter(numbers, lambda x: x NOT IN (1, 2, 3))) = 0 END AS verifiable,
  CASE WHEN len(sources) > 0 THEN len(list_filter(sources, lambda s: list_contains(numbers, s.rank) AND s.doc IN ('src1', 'src3', 's-3'))) > 0 END AS gold FROM said)
"""
_REFS = "text || CASE WHEN turn % 2 = 1 THEN chr(10) || chr(10) || 'References:' || chr(10) || 'of the th. an to' ELSE '' END"
_SHEET = """
WITH boxes AS (
  SELECT conv_id, turn, 0::BIGINT AS no, CASE conv_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 3 THEN 0.0 WHEN 4 THEN 0.5 END::DOUBLE AS mark, 'judgement' AS rest FROM conversations
  UNION ALL SELECT conv_id, turn, 1, CASE turn % 3 WHEN 0 THEN 0.0 WHEN 2 THEN 1.0 END::DOUBLE, '1. detail' FROM conversations)
"""
ORACLE = {
    "gold_parse": f"WITH {_gold('SELECT vec_id AS query_id FROM embeddings')} SELECT query_id, doc, array_to_string(pages, ',') AS pages FROM gold",
    "label_pages": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat_ws(',', doc_id, doc_id + 1, doc_id + 2) WHEN 2 THEN doc_id::VARCHAR ELSE '' END AS pages FROM documents",
    "retrieval_hits": _MARKED + "SELECT strategy, query_id, rank, doc_hit, page_hit FROM marked",
    "retrieval_reachability": _MARKED + "SELECT * FROM reach",
    "retrieval_first_rank": _MARKED + "SELECT * FROM metrics",
    "retrieval_strategy_summary": _MARKED
    + """SELECT strategy, count(*) AS questions, count_if(coalesce(reachable, FALSE))::BIGINT AS reachable, count_if(doc_hit)::BIGINT AS doc_hits, count_if(page_hit)::BIGINT AS page_hits,
  round_even(avg(n_academic), 1) AS mean_academic, round(count_if(page_hit) / count(*), 6) AS rate, round(count_if(page_hit AND reachable) / nullif(count_if(reachable), 0), 6) AS rate_reachable
FROM metrics LEFT JOIN reach USING (query_id) GROUP BY 1""",
    "query_strip_suffix": f"""
SELECT conv_id, turn, CASE WHEN r = '' THEN q ELSE r END AS question FROM (SELECT *, regexp_replace(regexp_replace(q, '{ASK_FOR}', ''), '^\\s+|\\s+$', '', 'g') AS r FROM (
  SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN text || ' please help me?' WHEN conv_id % 5 = 0 THEN 'help me' ELSE text END AS q FROM conversations WHERE role = 'user'))""",
    "citation_string": "SELECT doc_id, '[public] t (' || source || ') ' || CASE doc_id % 3 WHEN 0 THEN '12쪽' WHEN 1 THEN '12-14쪽' ELSE 'part' END || CASE WHEN doc_id % 5 = 0 THEN ' [OCR]' ELSE '' END AS cite FROM documents",
    "setting_label_codec": """
SELECT vec_id, concat_ws('/', 'fixed@' || vec_id % 12, CASE WHEN vec_id % 3 > 0 THEN 'doc' || vec_id % 3 END, CASE WHEN vec_id % 4 > 0 THEN 'pub' || vec_id % 4 END, CASE WHEN vec_id % 2 = 0 THEN 'en' END) AS label,
  (vec_id % 12)::INT AS k, nullif(vec_id % 3, 0)::INT AS per_doc, nullif(vec_id % 4, 0)::INT AS public, NULL::INT AS public_per_doc, vec_id % 2 = 0 AS translated FROM embeddings""",
    "scope_override_rules": f"""
WITH t AS (SELECT conv_id, turn, text, CASE conv_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'out' WHEN 2 THEN 'partial' ELSE 'what' END AS s0, regexp_matches(text, '(?i){TERMS}') AS named,
  list_filter(CASE WHEN turn % 3 = 0 THEN []::VARCHAR[] WHEN turn % 3 = 1 THEN ['anti x', 'bone'] ELSE ['the th'] END, lambda x: NOT regexp_matches(x, '(?i){TERMS}') AND NOT regexp_matches(x, '{STAGES}')) AS items,
  list_sort(list_distinct(regexp_extract_all(text, '{DISEASES}'))) AS found FROM conversations),
a AS (SELECT *, CASE WHEN s0 = 'what' THEN 'failed' WHEN s0 = 'out' AND named THEN CASE WHEN len(items) > 0 THEN 'partial' ELSE 'in' END ELSE s0 END AS s1 FROM t),
b AS (SELECT *, CASE WHEN s1 = 'partial' AND NOT named THEN 'out' ELSE s1 END AS s2 FROM a),
c AS (SELECT *, CASE WHEN s2 = 'partial' AND len(items) = 0 THEN 'in' ELSE s2 END AS s3 FROM b)
SELECT conv_id, turn, CASE WHEN s3 = 'failed' THEN 'in' WHEN s3 = 'in' AND len(found) > 0 THEN 'partial' ELSE s3 END AS scope,
  array_to_string(CASE WHEN s3 = 'failed' THEN [] WHEN s3 = 'in' AND len(found) > 0 THEN found ELSE items END, ',') AS items FROM c""",
    "context_assembly": "SELECT conv_id AS query_id, length(c) AS n, md5(c) AS h FROM (SELECT conv_id, string_agg('[' || turn || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS c FROM conversations GROUP BY 1)",
    "answer_refusal": f"SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN conv_id % 3 = 0 OR regexp_matches(text, '{REFUSAL}') END AS refused FROM conversations WHERE role = 'assistant'",
    "answer_askback": f"SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN conv_id % 4 = 0 OR regexp_matches(text, '{ASK}') END AS asked, NOT regexp_matches(text, 'which th|medic|[0-9]') AS must_ask FROM conversations WHERE role = 'assistant'",
    "answer_cited_numbers": _CITED + "SELECT conv_id, turn, array_to_string(numbers, ',') AS numbers, array_to_string(list_transform(list_filter(sources, lambda s: TRUE), lambda s: s.rank || ':' || s.doc), ',') AS sources FROM checks",
    "answer_verifiable_sources": _CITED + "SELECT conv_id, turn, verifiable FROM checks",
    "answer_gold_cited": _CITED + "SELECT conv_id, turn, gold FROM checks",
    "answer_check_matrix": _CITED
    + f""", long AS (SELECT 'run' || conv_id % 3 AS result, unnest([{{'check': 'verifiable', 'v': verifiable}}, {{'check': 'gold', 'v': gold}}, {{'check': 'banned', 'v': regexp_matches(text, '{BANNED}')}}]) AS x FROM checks)
SELECT result, x.check AS check, count_if(x.v)::BIGINT AS yes, count(x.v) AS asked FROM long GROUP BY 1, 2""",
    "guard_banned_expression": f"""
SELECT conv_id, turn, regexp_matches(b, '{BANNED}') AS banned, len(list_filter(string_split(regexp_replace(replace(b, chr(10), chr(30)), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda s: regexp_matches(s, '{ADJUST}'))) AS candidates
FROM (SELECT conv_id, turn, split_part({_REFS}, '{REFERENCES}', 1) AS b FROM conversations)""",
    "guard_drop_sentences": f"""
WITH b AS (SELECT conv_id, turn, {_REFS} AS t, split_part({_REFS}, '{REFERENCES}', 1) AS b FROM conversations),
l AS (SELECT *, list_transform(string_split(b, chr(10)), lambda x: CASE WHEN regexp_matches(x, 'th[a-z]* th') THEN chr(30) || array_to_string(list_filter(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: NOT regexp_matches(s, 'th[a-z]* th')), ' ') ELSE x END) AS ls FROM b)
SELECT conv_id, turn, md5(array_to_string(list_transform(list_filter(ls, lambda x: NOT (starts_with(x, chr(30)) AND trim(substring(x, 2)) = '')), lambda x: replace(x, chr(30), '')), chr(10)) || substring(t, length(b) + 1)) AS h FROM l""",
    "expected_scope": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'in,partial' WHEN conv_id % 3 = 0 THEN 'out' WHEN conv_id % 3 = 1 THEN 'partial' ELSE 'in' END AS scopes FROM conversations",
    "fingerprint": "SELECT doc_id, substring(sha256(text), 1, 12) AS h FROM documents",
    "snapshot_diff": """
SELECT 'labels > ' || doc_id AS path, CASE WHEN doc_id % 11 <> 0 THEN quality::VARCHAR END AS old, CASE WHEN doc_id % 10 <> 0 AND doc_id % 9 <> 0 THEN quality::VARCHAR END AS new
FROM labels WHERE (doc_id % 9 = 0 OR (doc_id % 10 = 0) <> (doc_id % 11 = 0)) AND NOT (doc_id % 10 = 0 AND doc_id % 11 = 0)""",
    "grading_rubric_split": """
SELECT doc_id, p[1] AS judgement, greatest(len(p) - 1, 0) AS details, array_to_string(p[2:], '|') AS joined FROM (
  SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', ' / '), ' / '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)""",
    "grading_sheet_parse": _SHEET + "SELECT conv_id, turn, no, mark, rest, CASE WHEN turn % 2 = 0 THEN turn END AS violations FROM boxes",
    "grading_score_report": _SHEET + "SELECT 'sheet' || conv_id % 4 AS sheet_id, CASE WHEN no = 0 THEN 'judgement' ELSE 'detail' END AS kind, count(*) AS boxes, count(mark) AS graded, count_if(mark = 1)::BIGINT AS full, round(avg(mark), 6) AS rate FROM boxes GROUP BY 1, 2",
    "embed_cache_misses": "SELECT DISTINCT sha1('m1' || chr(10) || text) AS key, text FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE conv_id % 3 = 0)",
    "embed_cache_upsert": "SELECT DISTINCT sha1('m1' || chr(10) || text) AS key, 8::BIGINT AS n FROM conversations",
    "answer_baseline": "SELECT conv_id * 1000 + turn AS query_id, trim(substring(list_last(string_split(text, chr(10))), 1, 80)) || ' [1]' AS answer FROM conversations WHERE role = 'user'",
    "query_translation_cache": """
WITH u AS (SELECT conv_id, turn, text, array_to_string(list_reverse(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), ' ') AS up FROM conversations WHERE role = 'user'),
k AS (SELECT DISTINCT text AS known FROM u WHERE conv_id % 3 = 0)
SELECT conv_id, turn, FALSE AS expand, CASE WHEN known IS NOT NULL THEN 'known' ELSE up END AS translated FROM u LEFT JOIN k ON text = known
UNION ALL SELECT conv_id, turn, TRUE, up FROM u""",
    "answer_scope_right": """
SELECT conv_id, turn, list_contains(CASE WHEN turn % 3 = 0 THEN ['in', 'partial'] WHEN conv_id % 3 = 0 THEN ['out'] WHEN conv_id % 3 = 1 THEN ['partial'] ELSE ['in'] END, CASE turn % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'partial' ELSE 'out' END) AS right FROM conversations""",
    "answer_auto_checks": """
WITH a AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 3 = 0 THEN ' [' || turn % 5 || '][2] and [' || conv_id % 7 || ']?' ELSE '' END AS a FROM conversations),
c AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(a, '\\[(\\d{1,9})\\]', 1), lambda x: x::INT))) AS c FROM a)
SELECT conv_id, turn, contains(a, 'the')::BIGINT + contains(a, 'ing')::BIGINT + contains(a, 'zq')::BIGINT AS n_parts, array_to_string(c, ',') AS cited, array_to_string(list_filter(c, lambda x: x NOT BETWEEN 1 AND 3), ',') AS invalid,
  list_contains(c, 2)::BIGINT AS n_academic, regexp_matches(a, '\\?|let me know') AS asks, regexp_matches(a, 'doctor|clinic|on') AS refers FROM c""",
    "answer_gold_found": _MARKED + """, best AS (SELECT query_id, list(DISTINCT doc) AS docs FROM found WHERE strategy = 'fused' GROUP BY 1), g AS (SELECT query_id, list(DISTINCT doc) AS gold FROM gold GROUP BY 1)
SELECT query_id, array_to_string(list_sort(list_filter(gold, lambda x: list_contains(docs, x))), ',') AS found, len(gold) AS n_gold FROM g JOIN best USING (query_id)""",
    "answer_checks_joined": f"""
WITH q AS (SELECT conv_id, first(text ORDER BY turn) AS question FROM conversations GROUP BY 1),
r AS (SELECT CASE WHEN turn % 4 = 1 THEN 'blank' ELSE 'full' END AS result, conv_id, turn, question, text || CASE WHEN conv_id % 3 = 0 THEN ' I will not answer. Please check [1][' || turn % 5 || ']' ELSE '' END AS a, turn % 4 <> 1 AS found FROM conversations JOIN q USING (conv_id) WHERE role = 'assistant'),
n AS (SELECT *, list_distinct(regexp_extract_all(a, '\\[(\\d{{1,9}})\\]', 1)) AS n, split_part(a, '{REFERENCES}', 1) AS b FROM r),
c AS (SELECT result,
  CASE WHEN conv_id % 4 = 0 THEN regexp_matches(a, '{REFUSAL}') END AS refused_out, CASE WHEN conv_id % 4 = 1 THEN regexp_matches(a, '{REFUSAL}') END AS refused_part,
  CASE WHEN found THEN list_contains(CASE WHEN conv_id % 5 = 0 THEN ['in', 'partial'] WHEN conv_id % 4 = 0 THEN ['out'] WHEN conv_id % 4 = 1 THEN ['partial'] ELSE ['in'] END, CASE WHEN conv_id % 2 = 0 THEN 'in' ELSE 'out' END) END AS scope_right,
  CASE WHEN regexp_matches(question, 'which th') THEN regexp_matches(b, '{BANNED}') END AS diagnosis,
  len(list_filter(string_split(regexp_replace(replace(b, chr(10), chr(30)), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda s: regexp_matches(s, '{ADJUST}'))) > 0 AS advice,
  CASE WHEN conv_id % 4 = 2 THEN regexp_matches(b, '{ASK}') END AS asked_back,
  CASE WHEN NOT found THEN FALSE ELSE len(n) > 0 AND len(list_filter(n, lambda x: x NOT IN ('1', '2'))) = 0 END AS verifiable,
  CASE WHEN found AND conv_id % 2 = 0 THEN (list_contains(n, '1') AND conv_id % 4 = 1) OR list_contains(n, '2') END AS gold_cited FROM n),
long AS (SELECT result, unnest([{{'check': 'refused_out', 'v': refused_out}}, {{'check': 'refused_part', 'v': refused_part}}, {{'check': 'scope_right', 'v': scope_right}}, {{'check': 'diagnosis', 'v': diagnosis}}, {{'check': 'advice', 'v': advice}}, {{'check': 'asked_back', 'v': asked_back}}, {{'check': 'verifiable', 'v': verifiable}}, {{'check': 'gold_cited', 'v': gold_cited}}]) AS x FROM c)
SELECT result, x.check AS check, coalesce(count_if(x.v), 0)::BIGINT AS yes, count(x.v) AS asked FROM long GROUP BY 1, 2""",
    "strategy_grid": _SCORED + """ SELECT CASE WHEN chunk_id % 2 = 0 THEN 'even' ELSE 'odd' END || '+doc2+en' AS strategy, query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id % 2 ORDER BY fused DESC, chunk_id) AS rank FROM s0) WHERE rank <= 3""",
    "grading_width": "SELECT doc_id, length(text) + 6 * (doc_id % 5) + 3 * CASE WHEN doc_id % 7 < 4 THEN 2 ELSE 1 END AS width FROM documents",
    "grading_cited_texts": """
SELECT conv_id AS number, rank, 'text ' || rank AS text, rank IN (2, conv_id % 4) AS cited FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn <= 1 AND conv_id % 3 <> 0) CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS rank)""",
    "grading_sheet_blocks": """
SELECT conv_id AS number, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS judgement, (CASE WHEN conv_id % 5 = 0 THEN 1.5 ELSE 0.5 END)::DOUBLE AS detail_score,
  CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS details_graded, 2::BIGINT AS details, 1::BIGINT AS cites_right, 2::BIGINT AS cites_graded, 2::BIGINT AS cites, CASE WHEN conv_id % 2 = 0 THEN conv_id % 4 END AS violations,
  CASE WHEN conv_id % 7 = 0 THEN 1.0 END::DOUBLE AS hit, CASE WHEN conv_id % 2 = 0 THEN 'O' ELSE 'X' END AS scope FROM conversations WHERE turn = 0""",
    "snapshot_settings": f"""
SELECT * FROM (VALUES ('model > answers', 'm'), ('model > temperature', '0'), ('search > strategy', 'fixed'), ('search > k', '10'), ('search > request', substring(sha256('{ASK_FOR}'), 1, 12)), ('rules > terms', substring(sha256('{TERMS}'), 1, 12)), ('rules > stages', substring(sha256('{STAGES}'), 1, 12))) t(path, value)
UNION ALL SELECT 'files > ' || doc_id, substring(sha256(text), 1, 12) FROM documents""",
    "grading_sheet_report": """
WITH c AS (SELECT conv_id, floor(conv_id / 20)::BIGINT AS sheet_id, sum(length(text)) AS n FROM conversations GROUP BY 1),
s AS (SELECT sheet_id, count(*) AS q, count(*) FILTER (conv_id % 3 <> 0) AS j, count(*) FILTER (conv_id % 2 = 0) AS o, count(*) FILTER (n <= 300) AS r, count(*) FILTER (n % 3 > 0) AS v, sum(n % 3) AS vs FROM c GROUP BY 1),
m AS (SELECT sheet_id, unnest(['judgement', 'details', 'citations', 'hits', 'questions with violations', 'violations', 'scopes']) AS measure, unnest([j, q / 2, q + r, q, v, vs, o])::DOUBLE AS reached,
  unnest([j, q, 2 * q, q, q, q, q])::DOUBLE AS graded, unnest([q - j, 0, 0, 0, 0, 0, 0])::DOUBLE AS blank FROM s)
SELECT *, CASE WHEN graded > 0 AND measure <> 'violations' THEN round(reached / graded, 6) END AS rate FROM m WHERE graded > 0 OR (blank > 0 AND measure = 'judgement')""",
}
