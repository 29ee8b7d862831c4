"""What may be fetched and when, without the network: robots files as rules (S6), a schedule of requests by site (S7), the encoding of raw bytes.

A robots file becomes rows: groups of agents with their rules in order. A site's rules for one agent are one row, an array,
so that a URL is joined to one row however many rules its site has. A schedule is a running maximum: a request that is
ready at t starts at t, or a gap after the one before it on its site; with the k-th of a site that is k gaps after the
greatest of what t less k gaps was so far. So blocks of time are summed up first and no site's requests lie in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent_decoded, settled, site_key
from ..sources.sinks import small_batches
from .acquire import robots_policy

#: Seconds of a block of the schedule.
BLOCK_SECONDS = 3600
#: Fixed order of the encodings that are tried, and the one that takes any bytes.
ENCODINGS = ("utf-8", "cp949", "shift_jis", "gb18030", "cp1251")
ANY = "latin-1"
#: So few high bytes, each run counted once, tell nothing of their encoding.
FEW = 4


def robots_rules(files: DataFrame) -> DataFrame:
    """Rows (site, group_no, agents, is_default, delay, rules) of robots files (site, body); rules (no, allow, path) in order.

    Agents that follow each other share what rules follow them; a blank line ends a group, and a group without rules is none.
    An empty ``Disallow`` allows all. Names of fields count in any case; comments, and fields that aren't known, are skipped.
    """
    lines = files.select("site", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\\r\\n|\\r|\\n")).alias("no", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$|\\t", " "))
    field, value = F.lower(F.trim(F.substring_index(bare, ":", 1))), F.trim(F.substring(bare, F.instr(bare, ":") + 1, F.length(bare)))
    kind = F.when(F.col("line") == "", "blank").when(F.instr(bare, ":") > 0, F.when(field == "user-agent", "agent").when(field.isin("allow", "disallow", "crawl-delay"), "rule"))
    told = lines.select("site", "no", kind.alias("kind"), field.alias("field"), value.alias("value")).filter("kind is not null")
    order = Window.partitionBy("site").orderBy("no")
    begins = (F.col("kind") == "agent") & ~F.lag("kind").over(order).eqNullSafe(F.lit("agent"))
    placed = told.withColumns({"begins": begins, "stretch": F.count_if(F.col("kind") == "blank").over(order)}).withColumn("group_no", F.count_if("begins").over(order))
    # a rule counts if its group began behind the last blank line
    whole = placed.filter("group_no > 0 and kind <> 'blank'").withColumn("home", F.first(F.when(F.col("begins"), F.col("stretch")), ignorenulls=True).over(Window.partitionBy("site", "group_no").orderBy("no"))).filter("stretch = home")
    path = F.when(F.col("kind") == "rule", F.struct(F.col("no").alias("no"), ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), percent_decoded(F.col("value")).alias("path"), (F.col("field") == "crawl-delay").alias("is_delay")))
    groups = whole.groupBy("site", "group_no").agg(F.collect_list(F.when(F.col("kind") == "agent", F.lower(percent_decoded(F.col("value"))))).alias("agents"), F.array_sort(F.collect_list(path)).alias("all"), F.max_by(F.when(F.col("field") == "crawl-delay", F.expr("try_cast(value as int)")), F.when((F.col("field") == "crawl-delay") & F.col("value").rlike("^[0-9]+$"), F.col("no"))).alias("delay"))
    rules = F.transform(F.filter("all", lambda r: ~r["is_delay"]), lambda r: F.struct(r["no"].alias("no"), r["allow"].alias("allow"), r["path"].alias("path")))
    return groups.filter(F.size("all") > 0).select("site", "group_no", "agents", F.array_contains("agents", "*").alias("is_default"), "delay", rules.alias("rules"))


def rules_for(files: DataFrame, agent: str) -> DataFrame:
    """Rows (site, delay, rules) for an agent: of the first group that names a part of it, else of the first one for all."""
    name = agent.split("/")[0].lower()
    groups = robots_rules(files).filter(F.col("is_default") | F.exists("agents", lambda a: F.contains(F.lit(name), a)))
    first = groups.groupBy("site").agg(F.min_by(F.struct("delay", "rules"), F.struct("is_default", "group_no")).alias("g"))
    return first.select("site", "g.delay", "g.rules")


def _matches(path: Column, pattern: Column) -> Column:
    """Whether a rule's path is a beginning of ``path``; * is any characters and a $ at its end is the end."""
    quoted = F.regexp_replace(pattern, "([\\\\.\\[\\](){}+?^|])", "\\\\$1")
    return F.rlike(path, F.concat(F.lit("^(?s)"), F.regexp_replace(F.regexp_replace(quoted, "\\*", ".*"), "\\$(?!$)", "\\\\\\$")))


def robots_allowed(urls: DataFrame, files: DataFrame, agent: str, longest: bool = False) -> DataFrame:
    """``urls`` (url, ...) with site, allowed and delay, by their site's robots file (site, status, body).

    The status decides first; a site without a file is one whose request failed. Of the rules the first one whose path is
    a beginning of the URL's decides; with ``longest`` the longest one, allowing ones first, with the
    wildcards * and $. Without one it is allowed.
    """
    site_of = urls.withColumn("site", site_key(F.col("url")))
    policy = files.select("site", robots_policy(F.col("status")).alias("policy"))
    ruled = policy.join(rules_for(files.filter(robots_policy(F.col("status")) == "rules"), agent), "site", "left")
    known = site_of.join(ruled, "site", "left")
    rest = F.regexp_replace(percent_decoded(F.col("url")), "^[^:/?#]+://[^/?#]*", "")
    placed = known.withColumn("path", settled(F.when(rest == "", "/").otherwise(rest)))
    if longest:
        fits = F.filter("rules", lambda r: (r["path"] != "") & _matches(F.col("path"), r["path"]))
        best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))["allow"]
    else:
        best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))["allow"]
    allowed = F.when(F.col("policy") == "allow", True).when(F.col("policy") == "rules", F.coalesce(best, F.lit(True))).otherwise(False)
    return placed.withColumn("allowed", allowed).drop("policy", "rules", "path")


def request_schedule(requests: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Requests (request_id, site, ready, gap) with start: the first second, from ``ready``, that is ``gap`` after the site's request before.

    Requests of a site go in order of ready, then request_id; the gap is the site's, the greatest of its rows'. Long
    sites are dealt in blocks of time: each block is numbered by itself and carries on from the blocks before.
    """
    placed = requests.withColumn("block", F.floor(F.col("ready") / block_seconds))
    sums = placed.groupBy("site", "block").agg(F.count("*").alias("n"), F.max("gap").alias("block_gap"))
    every = Window.partitionBy("site")
    before = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select("site", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.max("block_gap").over(every).alias("site_gap"))
    own = Window.partitionBy("site", "block").orderBy("ready", "request_id")
    numbered = placed.join(blocks, ["site", "block"]).withColumn("k", F.col("offset") + F.row_number().over(own) - 1).withColumn("slack", F.col("ready") - F.col("k") * F.col("site_gap"))
    carried = numbered.groupBy("site", "block").agg(F.max("slack").alias("most")).select("site", "block", F.max("most").over(before).alias("carry"))
    running = numbered.join(carried, ["site", "block"]).withColumn("start", F.col("k") * F.col("site_gap") + F.greatest("carry", F.max("slack").over(own)))
    return running.select("request_id", "site", "ready", F.col("site_gap").alias("gap"), "start")


def _letters(text: str) -> float:
    """How much a text looks like one: the share of letters, digits, white space and common marks, less what is no character of a text."""
    if not text:
        return 1.0
    good = sum(c.isalnum() or c.isspace() or c in ".,;:!?'\"()-/<>=&#%_" or 0x3000 <= ord(c) < 0x3040 or 0xFF00 <= ord(c) < 0xFF61 for c in text)
    bad = sum(0x80 <= ord(c) < 0xA0 or 0xE000 <= ord(c) < 0xF900 or c == "�" for c in text)
    # half-width forms and rare ideographs are what wrong decoders make of other bytes
    odd = sum(0xFF61 <= ord(c) <= 0xFF9F or 0x3400 <= ord(c) < 0x4E00 for c in text)
    return (good - 2 * bad - odd) / len(text)


def _scripts(text: str) -> int:
    """The number of changes of script between neighbouring letters."""
    kinds = [0 if c < "ɐ" else 1 if "Ѐ" <= c < "԰" else 2 if "぀" <= c < "㄀" else 3 if "가" <= c <= "힣" else 4 for c in text if c.isalpha()]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def guess_encoding(data: bytes | None, cut: int = 4) -> str | None:
    """The encoding of raw bytes without a stated one: what their mark says, UTF-8 if they are valid as such, else the likeliest.

    Bytes may be cut off within a character: an error in the last ``cut`` bytes is none. Other encodings are scored by
    their letters and by how seldom the script changes from letter to letter; of equal scores ANY's goes first where high bytes
    are FEW or no two are neighbours, else last. Null for null.
    """
    if data is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name
    scores = []
    for k, name in enumerate(ENCODINGS):
        try:
            text = data.decode(name)
        except UnicodeDecodeError as problem:
            if problem.start < len(data) - cut or problem.start == 0 or not re.search("unexpected end|incomplete", problem.reason):
                continue
            text = data[: problem.start].decode(name)
            # a last byte alone is no cut character: it may as well be a letter of ANY
            if text.isascii() and (name != "utf-8" or len(data) < problem.start + 2):
                continue
        if name == "utf-8":
            return name
        scores.append((_letters(text) - _scripts(text) / max(1, len(text)), -k, name))
    text = data.decode(ANY)
    lone = sum(map(len, set(re.findall(b"[\x80-\xff]+", data)))) <= FEW or not re.search(b"[\x80-\xff]{2}", data)
    scores.append((_letters(text) - _scripts(text) / max(1, len(text)) - sum("\xa1" <= c <= "\xbf" or c in "×÷" for c in text) / max(1, len(text)), 1 if lone else -len(ENCODINGS), ANY))
    return max(scores)[2]


def decoded(files: DataFrame) -> DataFrame:
    """Rows (key, encoding, text) of raw texts (key, content, charset): in the stated encoding if it is known, else in the guessed one; bytes that aren't of it are replaced."""
    small_batches(files.sparkSession)

    def read(data: bytes | None, stated: str | None) -> tuple[str | None, str | None]:
        name = guess_encoding(data) if not stated else stated
        if data is None:
            return None, None
        try:
            return name, data.decode(name, "replace")
        except LookupError:
            return (name := guess_encoding(data)), data.decode(name, "replace")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [read(data, stated) for data, stated in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            texts = [None if t is None else t.removeprefix("﻿").encode("utf-8", "replace").decode() for _, t in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.string()), pa.array(texts, pa.string())], ["key", "encoding", "text"])

    kind = files.schema["key"].dataType.simpleString()
    return files.select("key", "content", "charset").mapInArrow(batches, f"key {kind}, encoding string, text string")
