"""Operator 12: chat texts from event logs.

A log has an event for all that happens in a conversation. Its kinds:

- ``message``: a message of ``turn`` begins, with its role and first text;
- ``delta``: text that was streamed is put behind the turn's open message, the last one that began at or before it;
- ``edit``: the open message's text, all there was of it, is replaced, and later deltas go behind that;
- ``regenerate``: the turn's messages so far, and those of later turns, are thrown away; a message of the turn begins.

Logs are dealt by conversation and block of turns, sorted by sequence and folded: each event to its open message, messages
to the last edit and the deltas behind it, blocks to their messages. A long conversation so lies in many tasks; only its
final messages, which are its formatted text, come together in its row. What a regeneration throws away in later blocks
is found there, by the running maximum of the blocks' regenerations.

The template marks each turn as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. A control string
in a text gets a backslash behind its first character, and one more if it has some; taking one away again gives the text
back. The loss mask is a list of spans of the formatted text, the texts of assistants.

Nulls: a null text is empty, a null role is an empty one; a null turn comes before all others, a null sequence first in its
turn; rows of a null conversation are one conversation; events of no known kind, and deltas and edits without an open
message, are left out. Ties of a sequence go by kind (message, regenerate, edit, delta), then role, then text. Repeated
rows are events of their own: a repeated delta is put behind twice. Very long texts stay whole. An empty log gives no
conversation. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import running, settled

START, END = "<|im_start|>", "<|im_end|>"
#: Fixed control strings of public chat templates, behind their first character.
CONTROLS = ("|im_start|>", "|im_end|>", "|endoftext|>", "|eot_id|>", "|start_header_id|>", "|end_header_id|>", "|system|>", "|user|>", "|assistant|>", "|end|>", "s>", "/s>", "pad>", "unk>", "<SYS>>", "</SYS>>", "INST]", "/INST]")
KINDS = ("message", "regenerate", "edit", "delta")
ASSISTANT = "assistant"
BLOCK_BITS = 6  # 64 turns are a block
DELTA = 512  # characters of a streamed piece

_REST = "(?:" + "|".join("".join("\\" + c if not c.isalnum() and c not in "_<>" else c for c in rest) for rest in CONTROLS) + ")"
_MARKED, _ESCAPED = f"([<\\[])(?=\\\\*{_REST})", f"([<\\[])\\\\(?=\\\\*{_REST})"
MESSAGES = "array<struct<turn:bigint,seq:bigint,role:string,text:string>>"


def escape(text: Column) -> Column:
    """Text without control strings: those there were have a backslash more."""
    return F.regexp_replace(text, _MARKED, "$1\\\\")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, _ESCAPED, "$1")


def escape_role(role: Column) -> Column:
    """A role in one line: backslashes and line feeds, too, are written with a backslash."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """What ``escape_role`` was given."""
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def messages(log: DataFrame) -> DataFrame:
    """The final messages of a log (conv_id, seq, kind, turn, role, text): rows (conv_id, messages), in order of turn and sequence."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    least = -(1 << 63)
    events = log.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(least)).alias("turn"), F.coalesce(F.col("seq").cast("long"), F.lit(least)).alias("seq"),
        kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter("kind > 0").withColumn("block", F.shiftright("turn", BLOCK_BITS))
    dealt = events.repartition("conv_id", "block")
    keys = ["conv_id", "block", "turn"]
    order = Window.partitionBy(*keys).orderBy("seq", "kind", "role", "text")
    placed = dealt.withColumn("place", F.row_number().over(order)).withColumn("no", F.count_if(F.col("kind") <= 2).over(order)).withColumn("gone", F.max(F.when(F.col("kind") == 2, F.col("no"))).over(Window.partitionBy(*keys)))
    # messages before the turn's last regeneration are gone, and so is what has no message
    open_ = placed.filter("no >= greatest(1, gone)")
    piece = F.struct("place", "kind", "text")
    folded = open_.groupBy(*keys, "no").agg(
        F.min("seq").alias("seq"), F.max(F.when(F.col("kind") == 2, F.col("seq"))).alias("cut"), F.max_by("role", F.when(F.col("kind") <= 2, -F.col("place"))).alias("role"),
        F.max(F.when(F.col("kind") <= 3, F.col("place"))).alias("base"), F.array_sort(F.collect_list(piece)).alias("pieces"),
    )
    text = F.array_join(F.transform(F.filter("pieces", lambda p: p["place"] >= F.col("base")), lambda p: p["text"]), "")
    told = folded.select("conv_id", "block", "turn", "seq", "cut", "role", text.alias("text"))
    blocks = told.groupBy("conv_id", "block").agg(F.max("cut").alias("cut"), F.array_sort(F.collect_list(F.struct("turn", "seq", "role", "text", "cut"))).alias("own"))
    # of a block, then of all of them: what a regeneration of an earlier turn throws away, by the running maximum
    kept = blocks.select("conv_id", "block", "cut", settled(_standing(F.col("own"))).alias("own"))
    convs = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "cut", "own"))).alias("blocks"))
    cuts = convs.withColumn("cuts", settled(running(F.transform("blocks", lambda b: b["cut"]), F.lit(least), lambda a, c: F.greatest(a, c), "bigint")))
    left = F.flatten(F.transform("blocks", lambda b, i: F.filter(b["own"], lambda m: (i == 0) | (m["seq"] >= F.get("cuts", i - 1)))))
    return cuts.select("conv_id", settled(F.transform(left, lambda m: F.struct(F.nullif(m["turn"], F.lit(least)).alias("turn"), F.nullif(m["seq"], F.lit(least)).alias("seq"), m["role"].alias("role"), m["text"].alias("text")))).alias("messages")).filter(F.size("messages") > 0)


def _standing(own: Column) -> Column:
    """Messages in order of turn without those that began before the last regeneration of an earlier turn."""
    least = F.lit(-(1 << 63))
    # of each message: the turn, the greatest cut of earlier turns, and that with the turn's own
    kind = "struct<turn:bigint,before:bigint,all:bigint>"
    first = F.struct(least.alias("turn"), least.alias("before"), least.alias("all"))

    def step(a: Column, m: Column) -> Column:
        return F.struct(m["turn"].alias("turn"), F.when(a["turn"] == m["turn"], a["before"]).otherwise(a["all"]).alias("before"), F.greatest(a["all"], m["cut"]).alias("all"))

    states = running(own, first, step, kind)
    return F.transform(F.filter(F.arrays_zip(own.alias("m"), states.alias("s")), lambda x: x["m"]["seq"] >= x["s"]["before"]), lambda x: F.struct(x["m"]["turn"].alias("turn"), x["m"]["seq"].alias("seq"), x["m"]["role"].alias("role"), x["m"]["text"].alias("text")))


def rendered(convs: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, loss_spans) of ``messages``: spans (start, end) in characters of the formatted text, from 0, without ends."""
    part = lambda m: F.struct((m["role"] == ASSISTANT).alias("loss"), F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"))
    parts = convs.select("conv_id", settled(F.transform("messages", part)).alias("parts"))
    ends = running(F.col("parts"), F.lit(0), lambda a, p: a + F.length(p["head"]) + F.length(p["body"]) + len(END) + 1, "int")
    placed = parts.withColumn("ends", settled(ends))
    span = F.transform("parts", lambda p, i: F.when(p["loss"], F.struct((F.get("ends", i) - len(END) - 1 - F.length(p["body"])).alias("start"), (F.get("ends", i) - len(END) - 1).alias("end"))))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return placed.select("conv_id", settled(formatted).alias("formatted"), settled(F.filter(span, lambda s: s.isNotNull())).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The messages (role, text) of a formatted text."""
    pieces = F.split(formatted, "<\\|im_end\\|>\\n")
    texts = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(texts, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under a loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def log_of(turns: DataFrame, piece: int = DELTA) -> DataFrame:
    """The log that a table of turns (conv_id, turn, role, text) tells: whole messages, those of assistants as they were streamed.

    Rows of one turn are messages one after another, by role and text.
    """
    text = F.coalesce("text", F.lit(""))
    numbered = turns.select("conv_id", "turn", "role", text.alias("text"), F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("copy"))
    streamed = F.when(F.col("role") == ASSISTANT, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    first = F.struct(F.lit("message").alias("kind"), F.when(F.col("role") == ASSISTANT, "").otherwise(F.col("text")).alias("text"))
    events = numbered.select("conv_id", "turn", "role", "copy", settled(F.concat(F.array(first), F.transform(streamed, lambda t: F.struct(F.lit("delta").alias("kind"), t.alias("text"))))).alias("events"))
    each = events.select("conv_id", "turn", "role", "copy", F.posexplode("events").alias("at", "event"))
    return each.select("conv_id", (F.shiftleft(F.col("copy").cast("long"), 32) + F.col("at")).alias("seq"), "event.kind", "turn", "role", "event.text")


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    """The contract's query: all ``conversations`` and conversation -7, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    # a row of the plan, not of a Python table
    added = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", ASSISTANT))])).alias("x")).select(F.lit(-7).cast("long").alias("conv_id"), "x.turn", "x.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = rendered(messages(log_of(turns.unionByName(added))))
    back = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), settled(read_back(F.col("formatted"))).alias("turns"), settled(F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(told).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars")


_SQL_REST = _REST.replace("'", "''")
OP12_SQL = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (SELECT *, regexp_replace(text, '([<\\[])(\\\\*{_SQL_REST})', '\\1\\\\\\2', 'g') AS body FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + {len(START) + len(END) + 2})::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""
