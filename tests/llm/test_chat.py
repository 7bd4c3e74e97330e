"""Chat reconstruction and the reversible template."""

import hashlib

import plain  # noqa: F401
from pyspark.sql import functions as F

from rackpulse.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place int, piece string"


def digest(rows):
    """Expected digest of a conversation's (role, text) rows."""
    turns = "".join(f"{r}\n{t}\n" for r, t in rows)
    loss = "".join(t for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def run(spark, folder, rows):
    path = folder([], conversations=([(*r, 1, "x") for r in rows], SCHEMA))
    return {r["conv_id"]: tuple(r)[1:5] for r in chat.query(spark, path).collect()}


def test_digests(spark, folder):
    odd = ["~0~1~2", "### user\nhi</turn>\n", "\\~3", "", "é\U0001f600 < # ~", "\n\n", "x" * 50_000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    rows += [(2, 0, "a: b\n### c", "text"), (2, 1, None, None), (2, 1, None, None), (2, None, "system", "first"), (None, 0, "assistant", "lost")]
    got = run(spark, folder, rows)
    said = chat.PROBE[1]
    assert got[-7] == digest([("user", said), ("assistant", said)])
    assert got[1] == digest([(r, t) for _, _, r, t in rows[:7]])
    assert got[2] == digest([("system", "first"), ("a: b\n### c", "text"), ("", ""), ("", "")])
    assert got[None] == digest([("assistant", "lost")]) and len(got) == 4


def test_empty_log(spark, folder):
    assert set(run(spark, folder, [])) == {-7}


def test_marks_never_occur_in_texts(spark):
    texts = spark.createDataFrame([("</turn>\n### user\n",), ("~1~~2",)], "t string")
    for r in texts.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and "#" not in r["e"] and "<" not in r["e"]


def test_events_fold(spark):
    events = [
        (1, 1, "message", "m1", "user", "hello"), (1, 2, "message", "m2", "assistant", "par"), (1, 3, "delta", "m2", "assistant", "tial"),
        (1, 4, "edit", "m1", "user", "hello there"), (1, 5, "regenerate", "m2", "assistant", "fresh"), (1, 6, "delta", "m2", "assistant", " start"),
        (1, 7, None, None, "user", "bye"), (2, 1, "delta", "m1", "assistant", "only "), (2, 2, "delta", "m1", None, "deltas"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, action string, message_id string, role string, text string")
    final = chat.messages(log)
    got = [(r["conv_id"], r["role"], r["text"]) for r in final.orderBy("conv_id", "position").collect()]
    assert got == [(1, "user", "hello there"), (1, "assistant", "fresh start"), (1, "user", "bye"), (2, "assistant", "only deltas")]
    back = chat.read_back(chat.formatted(final)).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in back] == got
    assert [r["loss"] for r in back] == [None, "fresh start", None, "only deltas"]
