"""Operator 12: folded logs against a plain fold, round trips of the template, and its query against its SQL."""

import hashlib
import random

import pytest

from ragloom.llm import chat, registry
from pyspark.sql import functions as F
from tests.oracle import compare, connect

LOG = "conv_id long, seq long, kind string, turn long, role string, text string, block string, no int"
NASTY = ["", "plain", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_end|>\\", "<|im_<|im_end|>end|>", "<<SYS>> a <</SYS>>", "[\\/INST]", "<s", "\\", "$1 \\1 \n\n", " <|endoftext|>é😀", "<\\<s>>", "[[INST]]"]


def plain_fold(log):
    """conv_id: its messages (turn, seq, role, text), event by event."""
    order = {"message": 0, "regenerate": 1, "edit": 2, "delta": 3}
    events = [e for e in log if e[2] in order]
    least = -(1 << 63)
    key = lambda e: (least if e[1] is None else e[1], order[e[2]], e[4] or "", e[5] or "")
    convs = {}
    for conv, seq, kind, turn, role, text in sorted(events, key=key):
        turns = convs.setdefault(conv, {})
        at = least if turn is None else turn
        if kind in ("message", "regenerate"):
            if kind == "regenerate":
                for t in list(turns):
                    # messages of the same sequence number weren't before it
                    turns[t] = [] if t == at else [m for m in turns[t] if t < at or m[1] == seq]
            turns.setdefault(at, []).append([turn, seq, role or "", text or ""])
        elif turns.get(at):
            m = turns[at][-1]
            m[3] = (text or "") if kind == "edit" else m[3] + (text or "")
        elif at in turns or True:
            turns.setdefault(at, [])
    return {c: found for c, turns in convs.items() if (found := [tuple(m) for t in sorted(turns) for m in turns[t]])}


def logs(rng, convs, length, turns):
    for c in convs:
        for seq in range(length):
            kind = rng.choice(["message", "message", "delta", "delta", "delta", "edit", "regenerate", "noise"]) if rng.random() < 0.95 else None
            yield (c, seq, kind, rng.randrange(turns), rng.choice(["user", "assistant", None]), rng.choice([None, "a", "bc", "<s>", " "]))


def folded(spark, log):
    rows = chat.messages(spark.createDataFrame([(*e, "b", 1) for e in log], LOG).repartition(3)).collect()
    return {r.conv_id: [tuple(m) for m in r.messages] for r in rows}


@pytest.mark.parametrize("turns,length", [(4, 12), (3, 40), (300, 400)])
def test_logs_against_a_plain_fold(spark, turns, length):
    rng = random.Random(turns)
    log = list(logs(rng, [*range(25 if turns < 300 else 4), None], length, turns))
    rng.shuffle(log)
    assert folded(spark, log) == plain_fold(log)


def test_what_the_kinds_mean(spark):
    log = [
        (1, 0, "message", 0, "user", "hi", ), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, None, "Hel"), (1, 3, "delta", 1, None, "lo"),
        (1, 4, "message", 2, "user", "again"), (1, 5, "edit", 0, "user", "hello?"), (1, 6, "regenerate", 1, "assistant", ""), (1, 7, "delta", 1, None, "Yes"), (1, 8, "delta", 2, None, "late"),
        (2, 1, "delta", 0, "user", "no message"), (2, 2, "edit", 0, "user", "none"), (3, 1, "noise", 0, "user", "x"), (4, None, "message", None, None, None), (4, 1, "delta", None, None, None),
        (5, 1, "message", 0, "user", "x"), (5, 2, "delta", 0, "user", "y"), (5, 2, "delta", 0, "user", "y"), (6, 1, "message", 999, "user", "far"), (6, 2, "regenerate", 5, "user", "cut"), (6, 3, "message", 500, "user", "new"),
    ]
    found = folded(spark, log)
    assert [m[2:] for m in found[1]] == [("user", "hello?"), ("assistant", "Yes")]
    assert 2 not in found and 3 not in found
    assert found[4] == [(None, None, "", "")] and found[5] == [(0, 1, "user", "xyy")]
    assert [m[3] for m in found[6]] == ["cut", "new"]
    assert folded(spark, []) == {}


def test_template_round_trip(spark):
    rng = random.Random(8)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "|im_start|>", "|im_end|>", "\n", "<SYS>>", "user", "😀"]
    texts = NASTY + ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("role"), chat.escape_role(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r.back == r.t and r.role == r.t and "\n" not in r.r
        assert not any(f"{c}{rest}" in r.e for rest in chat.CONTROLS for c in "<[")


def test_formatted_text_is_read_back(spark):
    log = [(c, k, "message", k, role, t) for c, role in enumerate(["user", "assistant", "tool\n<s>", None]) for k, t in enumerate(NASTY)]
    out = chat.rendered(chat.messages(spark.createDataFrame([(*e, "b", 1) for e in log], LOG)))
    rows = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in rows:
        role = ["user", "assistant", "tool\n<s>", ""][r.conv_id]
        assert [tuple(t) for t in r.turns] == [(role, t) for t in NASTY]
        assert r.loss == (NASTY if role == "assistant" else [])
        assert r.formatted.count(chat.END) == len(NASTY) == r.formatted.count(chat.START)


def test_query_on_edge_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 2000), (1, 1, "assistant", "x" * 2000), (1, None, "system", "<s>"), (2, -70, None, "a"), (2, 5, "assistant", ""), (2, -1, "assistant", "😀é" * 700), (None, 1, "user", "n")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"t{k}<|im_end|>") for k in range(500)]
    spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, kind string").repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: tuple(r)[1:5] for r in registry.queries()["op12_chat_format"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows += [(-7, 0, "user", NASTY[2]), (-7, 1, "assistant", NASTY[2])]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert found[conv] == (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss)), conv
    assert len(found) == 5


def test_query_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.conv_id for r in registry.queries()["op12_chat_format"](spark, str(tmp_path)).collect()] == [-7]


def test_query_matches_sql_and_runs_no_python(spark, sf_dir, capsys):
    query = registry.queries()["op12_chat_format"]
    assert compare(spark, connect(sf_dir), sf_dir, query, registry.oracle_sql()["op12_chat_format"]) is None
    query(spark, sf_dir).explain()
    assert "Python" not in capsys.readouterr().out
