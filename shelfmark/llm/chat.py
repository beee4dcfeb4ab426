"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to one string.  Where its turns
begin and end is not asked of it but found: successive prefixes of the conversation are rendered,
and where each output starts with the one before, the rest is the span of the new turn.  A template
that changes what it wrote before is reported with the first turn that made it do so.  Within the
span of a trained turn, the text is found by rendering the same prefix with two other texts: what
the outputs share in front and behind is the frame around the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# What marks turns in the output, and control strings of common templates, which get
# a backslash after their first character inside texts so that no text can open or close a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    re.escape(OPEN) + r"((?:[^\\\n]|\\.)*+)\n((?:[^\\<]++|\\.|<(?!\|))*+)" + re.escape(CLOSE) + r"\n",
    re.DOTALL,
)

RESULT = (
    "n_turns long, formatted string, rewritten_at long, "
    "turns array<struct<role:string,start:long,end:long,text_start:long,text_end:long>>"
)


def escape(text: str) -> str:
    """Backslashes doubled, control strings broken by one; ``unescape`` undoes it for every text."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    # "<\|" stands for "<|": the backslash goes, the character behind it stays.
    return _ESCAPED.sub(r"\1", text)


def chat_template(turns: list[Turn]) -> str:
    """Role and text of every turn between markers; both escaped, line breaks in roles too."""
    return "".join(
        f"{OPEN}{escape(role).replace('\n', '\\\n')}\n{escape(text)}{CLOSE}\n" for role, text in turns
    )


def parse(formatted: str) -> list[Turn]:
    """The turns that ``chat_template`` has written, read back from its output."""
    turns, at = [], 0
    while m := _TURN.match(formatted, at):
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return turns


def _frame(before: str, turns: list[Turn], template: Template) -> tuple[int, int]:
    """Characters around the text of the last turn, in front (from the span's start) and behind."""
    role = turns[-1][0]
    pieces = [template([*turns[:-1], (role, probe)])[len(before) :] for probe in ("a", "b")]
    front = len(commonprefix(pieces))
    return front, len(commonprefix([p[::-1] for p in pieces]))


def locate(turns: list[Turn], template: Template, trained: frozenset[str]) -> dict:
    """Render ``turns`` prefix by prefix: output, spans, text spans of trained roles, first rewrite.

    Of a template that rewrites history no span is given, for none can be trusted.
    """
    before, spans, rewritten = "", [], None
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            rewritten, spans = k, []
            before = template(turns)
            break
        span = {"role": role, "start": len(before), "end": len(now), "text_start": None, "text_end": None}
        if role in trained:
            front, behind = _frame(before, turns[: k + 1], template)
            span |= {"text_start": len(before) + front, "text_end": len(now) - behind}
        spans.append(span)
        before = now
    return {"n_turns": len(turns), "formatted": before, "rewritten_at": rewritten, "turns": spans}


def format_conversations(
    conversations: DataFrame,
    template: Template = chat_template,
    trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, rewritten_at, turns``.

    Spans count code points of ``formatted``.  Needs ``conv_id, turn, role, text``; other columns
    are not read.  Null roles and texts are empty; rows with a null id are one conversation; a null
    turn comes first; turns of equal number are ordered by role and text; repeated rows are turns of
    their own.  An empty table gives no rows.

    A conversation is rendered as a whole, so it must fit a task, which holds one conversation at a
    time; the turns reach it sorted, in batches, not as a collected group.  Rendering every prefix
    takes work in the square of a conversation's length: what a black box costs.
    """
    roles = frozenset(trained)
    schema = conversations.select("conv_id").schema["conv_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, chars = [], 0
        for conv_id, group in groupby(rows(batches), key=lambda row: row[0]):
            turns = [(role or "", text or "") for _, role, text in group]
            done.append({"conv_id": conv_id} | locate(turns, template, roles))
            chars += len(done[-1]["formatted"])
            if chars > 4_000_000 or len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, out)
                done, chars = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, out)

    span = [("role", pa.string())] + [(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")]
    id_type = pa.int64() if schema.dataType.typeName() == "long" else pa.string()
    if id_type == pa.string():
        conversations = conversations.withColumn("conv_id", F.col("conv_id").cast("string"))
    out = pa.schema(
        [
            ("conv_id", id_type),
            ("n_turns", pa.int64()),
            ("formatted", pa.string()),
            ("rewritten_at", pa.int64()),
            ("turns", pa.list_(pa.struct(span))),
        ]
    )
    kind = "long" if id_type == pa.int64() else "string"
    ordered = (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInArrow(render, f"conv_id {kind}, {RESULT}")
