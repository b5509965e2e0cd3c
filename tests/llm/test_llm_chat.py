"""Chat formatting: exact round trip of texts and mask, placeholders and their records."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelattice.llm import chat

ROW = f"conv_id long, turn long, role string, content array<{chat.PART}>"


def part(kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, uri, width, height, seconds, pages)


def read(spark, rows):
    made = chat.format_chats(spark.createDataFrame(rows, ROW))
    return {r.conv_id: r for r in made.select("*", chat.read_turns().alias("turns"), chat.read_loss().alias("taught")).collect()}


TEXT = st.one_of(st.none(), st.text(alphabet="<|\\\n>ai_m1 é\U0001f600", max_size=12), st.sampled_from(["<|im_end|>", "<|im_start|>assistant ok", "<\\|nl|>", "<"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.one_of(st.sampled_from(["user", "assistant"]), TEXT), TEXT), min_size=1, max_size=60))
def test_round_trip(spark, items):
    rows = [(conv, i, role, text) for i, (conv, role, text) in enumerate(items)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(chat.text_messages(df))
    for r in made.select("*", chat.read_turns().alias("turns"), chat.read_loss().alias("taught")).collect():
        mine = [(role or "", text or "") for conv, _, role, text in rows if conv == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert r.taught == [text for role, text in mine if role == "assistant"]
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(mine)
        spans = [r.formatted[s.begin : s.begin + s.length] for t in r.loss for s in t.spans]
        assert len(spans) == len(r.taught) and not any(chat.START in s or chat.END in s for s in spans)


def test_parts(spark):
    user = [part("text", "see "), part("image", uri="a.png", width=57, height=28), part("audio", uri="b.wav", seconds=2.01), part(None, " end")]
    bot = [part("document", uri="c.pdf", pages=3), part("text", ""), part("image", uri="d.png"), part("text", "yes <|image_1|>"), part("video", uri="e")]
    r = read(spark, [(1, 1, "assistant", bot), (1, 0, "user", user), (2, 0, "user", None), (2, 1, None, [])])[1]
    assert r.formatted == (
        "<|im_start|>user\nsee <|image_1|><|audio_2|> end<|im_end|>\n"
        "<|im_start|>assistant\n<|document_3|><|image_4|>yes <\\|image_1|><|attachment_5|><|im_end|>\n"
    )
    assert [(a.number, a.kind, a.uri, a.turn, a.part, a.tokens) for a in r.attachments] == [
        (1, "image", "a.png", 0, 1, 3), (2, "audio", "b.wav", 0, 2, 51), (3, "document", "c.pdf", 1, 0, 768),
        (4, "image", "d.png", 1, 2, 0), (5, "video", "e", 1, 4, 0),
    ]
    assert all(r.formatted[a.at :].startswith("<|") for a in r.attachments)
    assert r.media_tokens == 822
    assert r.taught == ["", "yes <|image_1|>"]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 0, "assistant", [part("text", "x")]), (3, 0, "user", [part("text", "a")])]
    rows += [(3, 0, "user", [part("text", "a")])] * 2 + [(3, 0, "assistant", [part("text", "w " * 100_000), part("text")])]
    got = read(spark, rows)
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("assistant", "x")]
    assert [t.role for t in got[3].turns] == ["assistant", "user", "user", "user"]
    assert got[3].taught == ["w " * 100_000, ""]
    assert chat.format_chats(spark.createDataFrame([], ROW)).collect() == []
    extra = spark.createDataFrame(rows, ROW).selectExpr("*", "'x' as formatted", "'y' as _id", "1 as loss")
    assert chat.format_chats(extra).count() == 2
    with pytest.raises(ValueError):
        chat.format_chats(extra.drop("role"))


def test_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(chat.text_messages(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hash") == 1


def test_many_turns_of_one_conversation(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("ab<|").alias("text"))
    r = chat.format_chats(chat.text_messages(rows)).select(F.size(chat.read_loss()).alias("n"), F.char_length("formatted").alias("c")).first()
    assert (r.n, r.c) == (20_000, 20_000 * (12 + 10 + 5 + 10 + 1))
