"""Chat format: typed parts, escapes, spans, and cases beyond the table."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trainlake.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string, start long"


def part(kind, text=None, ref=None, tokens=None):
    return (kind, text, ref, tokens)


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r.conv_id: r for r in chat.format_chats(df, F.col("parts")).collect()}


def test_typed_parts(spark):
    rows = [
        (1, 1, "assistant", [part("text", "It is "), part("image", ref="b.png", tokens=2), part("text", "nice")]),
        (1, 0, "user", [part("text", "What|?"), part("image", "alt", "a.png", 3), part("audio", ref="c.wav"), part("document", ref="d.pdf", tokens=0), part("video", ref="e.mp4", tokens=2)]),
        (2, 0, None, None),
        (2, 1, "assistant", []),
        (2, 2, "assistant", [part(None, "plain"), None, part("text", None)]),
        (None, 0, "user", [part("text", "lost")]),
    ]
    got = formatted(spark, rows)
    assert got[1].formatted == (
        "<|im_start|>user<|im_sep|>What\\|?<|image|><|image|><|image|><|audio|><|document|><|attachment|><|attachment|><|im_end|>\n"
        "<|im_start|>assistant<|im_sep|>It is <|image|><|image|>nice<|im_end|>\n"
    )
    assert [(a.turn, a.type, a.ref, a.tokens) for a in got[1].attachments] == [
        (0, "image", "a.png", 3), (0, "audio", "c.wav", 1), (0, "document", "d.pdf", 1), (0, "video", "e.mp4", 2), (1, "image", "b.png", 2),
    ]
    for a in got[1].attachments:
        assert got[1].formatted[a.start :].startswith(chat.PLACEHOLDERS.get(a.type, chat.OTHER_PLACEHOLDER) * a.tokens)
    assert [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_spans] == ["It is ", "nice"]
    assert got[2].formatted == "<|im_start|><|im_sep|><|im_end|>\n<|im_start|>assistant<|im_sep|><|im_end|>\n<|im_start|>assistant<|im_sep|>plain<|im_end|>\n"
    assert got[2].n_turns == 3 and got[None].n_turns == 1
    assert formatted(spark, []) == {}


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("<|>\\\nim_startendsep "), st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), max_size=25)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "sy|st\\em\n", ""]), st.one_of(st.none(), TEXTS)), min_size=1, max_size=6)


@settings(max_examples=8, deadline=None)
@given(st.lists(TURNS, min_size=1, max_size=12))
def test_round_trip(spark, chats):
    rows = [(c, k, role, text) for c, turns in enumerate(chats) for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df, chat.text_part(F.col("text")))
    read = out.select("conv_id", "formatted", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in read.collect():
        turns = [(role, text or "") for role, text in chats[r.conv_id]]
        assert [(t.role, t.text) for t in r.turns] == turns and r.n_turns == len(turns)
        assert r.loss == [text for role, text in turns if role == "assistant"]
        assert len(re.findall(r"<\|.*?\|>", r.formatted)) == 3 * len(turns)


def test_ties_and_repeats(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (1, 0, None, "z")], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_chats(df, chat.text_part(F.col("text"))).select("n_turns", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    assert [t.text for t in row.turns] == ["first", "z", "a", "a", "b"] and row.n_turns == 5


def test_long_conversation_is_native(spark):
    df = spark.range(20_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("word " * 20).alias("text"))
    out = chat.digests(chat.format_chats(df, chat.text_part(F.col("text"))))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    (row,) = out.collect()
    assert (row.n_turns, row.loss_chars) == (20_000, 2_000_000)
