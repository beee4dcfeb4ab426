from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import chat

PARTS = ["</s>", "[INST]", "[/INST]", "<s>", chat.OPEN, chat.CLOSE, "\\", "<|", "\n", "é", "漢", "a ", "|>", "<", "["]
TEXT = st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=8).map("".join)
TURNS = st.lists(st.tuples(TEXT, TEXT), max_size=5)


@given(TURNS)
@settings(max_examples=300, deadline=None)
def test_template_round_trip(turns):
    out = chat.chat_template(turns)
    assert chat.parse(out) == turns
    assert not any(c in out for c in ("</s>", "<s>", "[INST]", "[/INST]"))


@given(TURNS)
@settings(max_examples=200, deadline=None)
def test_spans_found_without_knowing_the_template(turns):
    found = chat.locate(turns, chat.chat_template, frozenset(r for r, _ in turns))
    assert found["rewritten_at"] is None and found["formatted"] == chat.chat_template(turns)
    at = 0
    for span, (role, text) in zip(found["turns"], turns, strict=True):
        assert span["start"] == at and span["role"] == role
        at = span["end"]
        assert chat.unescape(found["formatted"][span["text_start"] : span["text_end"]]) == text
    assert at == len(found["formatted"])


def test_rewriting_templates_are_reported():
    def last_thought_only(turns):
        return "".join(
            f"<{r}>{t if k == len(turns) - 1 else t.split('//')[0]}" for k, (r, t) in enumerate(turns)
        )

    found = chat.locate([("user", "a"), ("assistant", "b//c"), ("user", "d")], last_thought_only, frozenset())
    assert found["rewritten_at"] == 2 and found["turns"] == [] and found["formatted"] == "<user>a<assistant>b<user>d"

    def numbered(turns):
        return f"{len(turns)}:" + "".join(t for _, t in turns)

    assert chat.locate([("u", "a"), ("u", "b")], numbered, frozenset())["rewritten_at"] == 1


def test_conversations(spark):
    rows = [
        (1, 2, "assistant", "yes", "x"), (1, 1, "user", "no", "x"), (1, 1, "user", None, "x"),
        (2, None, None, "late", "x"), (2, 5, "assistant", "end", "x"),
        (None, 1, "user", "lost", "x"), (None, 2, "user", "lost", "x"),
        (3, 1, "user", "same", "x"), (3, 1, "user", "same", "x"),
        (4, 1, "assistant", "long " * 200_000, "x"), (5, 1, "user", "", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    turns = {k: chat.parse(r.formatted) for k, r in got.items()}
    assert turns[1] == [("user", ""), ("user", "no"), ("assistant", "yes")]
    assert turns[2] == [("", "late"), ("assistant", "end")]
    assert turns[None] == [("user", "lost")] * 2 and turns[3] == [("user", "same")] * 2
    assert turns[4] == [("assistant", "long " * 200_000)] and turns[5] == [("user", "")]
    loss = [got[1].formatted[s.text_start : s.text_end] for s in got[1].turns if s.text_start is not None]
    assert loss == ["yes"] and all(r.n_turns == len(turns[k]) for k, r in got.items())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_query_digests(spark):
    from shelfmark.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    by_conv = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by_conv.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, sf_dir).collect()}
    assert got.keys() == by_conv.keys()
    for k, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), sha(said))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss))
