"""Chat formatting by prefix-target expansion: every assistant turn is an example, all preceding turns are its context.

A turn is written `<s>ROLE\\nTEXT</s>`. Control strings inside roles and texts get `\\.` after their first character,
backslashes are doubled and a line break in a role is `\\n`, so that the output reads back exactly.

The row of an example holds its whole text, context included, and how many characters of it are context, so a conversation
of n turns takes up to n * n / 2 turns. Turns that no example ends with are rows of their own, which add to the context.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL_STRINGS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SEGMENT_CHARS = 1 << 20

_CONTROL = re.compile("|".join(re.escape(mark) for mark in CONTROL_STRINGS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>", re.DOTALL)
_MEANING = {"\\": "\\", ".": "", "n": "\n"}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANING[m[1]], text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text starts and ends in it."""
    head = "<s>" + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def read_turns(segment: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(segment)]


class _Conversation:
    """Turns of one conversation, in order, on their way into examples."""

    def __init__(self, conv_id):
        self.conv_id, self.example, self.turns, self.chars = conv_id, 0, 0, 0
        self.context: list[str] = []
        self.pending: list[str] = []
        self.pending_chars = self.pending_turns = 0

    def _row(self, loss_start=None, loss_end=None):
        added = "".join(self.pending)
        self.context.append(added)
        if loss_start is not None:
            self.context = ["".join(self.context)]
        text = added if loss_start is None else self.context[0]
        row = (self.conv_id, self.example, self.turns, self.pending_turns, self.chars, loss_start, loss_end, text)
        self.example += 1
        self.turns += self.pending_turns
        self.chars += self.pending_chars
        self.pending, self.pending_chars, self.pending_turns = [], 0, 0
        return row

    def add(self, role: str, text: str, segment_chars: int):
        piece, start, end = render_turn(role, text)
        at = self.chars + self.pending_chars
        self.pending.append(piece)
        self.pending_chars += len(piece)
        self.pending_turns += 1
        if role == "assistant":
            yield self._row(at + start, at + end)
        elif self.pending_chars >= segment_chars:
            yield self._row()

    def close(self):
        if self.pending:
            yield self._row()


def _streamed(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(name).to_pylist() for name in columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of some thousand rows or a few million characters."""
    block, weight = [], 0
    for row in rows:
        block.append(row)
        weight += 64 + sum(len(value) for value in row if isinstance(value, (str, bytes)))
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
            block, weight = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)


def prefix_examples(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """One row per example: conv_id, example, context_turns, new_turns, context_chars, loss_start, loss_end, text.

    `text` is the whole example: its first `context_chars` characters are all turns before, the rest its new turns; only
    characters loss_start..loss_end, the reply, are trainable. Turns after the last reply, and runs of other turns of over
    `segment_chars` characters, are rows without trainable text, and their `text` is the new turns alone.

    Turns go by `turn`, ties by role and text, nulls first; repeated rows are turns of their own. Null role or text is
    empty. Rows with a null key form one conversation. Other columns are dropped. No rows give no examples. One shuffle;
    a task streams its conversations in order and holds the text of one.
    """
    rows = conversations.select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("context_turns", pa.int64()),
                        ("new_turns", pa.int64()), ("context_chars", pa.int64()), ("loss_start", pa.int64()),
                        ("loss_end", pa.int64()), ("text", pa.string())])

    def build(batches):
        def examples():
            current = None
            for conv_id, kind, said in _streamed(batches, ["conv_id", "role", "text"]):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        yield from current.close()
                    current = _Conversation(conv_id)
                yield from current.add(kind or "", said or "", segment_chars)
            if current is not None:
                yield from current.close()

        return _batches(examples(), schema)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        build, "conv_id long, example long, context_turns long, new_turns long, context_chars long, loss_start long, "
        "loss_end long, text string",
    )


def expanded(examples: DataFrame) -> DataFrame:
    """The examples that have a reply: conv_id, example, text, loss_start, loss_end."""
    return examples.filter("loss_start is not null").select("conv_id", "example", "text", "loss_start", "loss_end")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: counts and SHA-256 digests of its turns and of its trainable text.

    SHA-256 runs over a conversation's turns in order, so one task streams each conversation and holds one example. An example
    whose context is not the text before it stops the job.
    `formatted_chars` sums the lengths of the whole examples, contexts included; turns that no example ends with count once.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("n_examples", pa.int64())])

    def digest(batches):
        def rows():
            current, state = None, None
            for conv_id, before, start, end, text in _streamed(
                batches, ["conv_id", "context_chars", "loss_start", "loss_end", "text"]
            ):
                if state is None or conv_id != current:
                    if state is not None:
                        yield finished(current, state)
                    current = conv_id
                    state = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_n": 0, "chars": 0, "tail": 0, "examples": 0, "whole": ""}
                if start is None:
                    added, state["whole"] = text, state["whole"] + text
                else:
                    if text[:before] != state["whole"]:
                        raise ValueError(f"conversation {conv_id}: the context of an example is not the text before it")
                    added, state["whole"] = text[before:], text
                for role, words in read_turns(added):
                    state["turns"].update(f"{role}\n{words}\n".encode("utf-8", "surrogatepass"))
                    state["n"] += 1
                state["tail"] += len(added)
                if start is not None:
                    said = unescape(text[start:end])
                    state["loss"].update(said.encode("utf-8", "surrogatepass"))
                    state["loss_n"] += len(said)
                    state["chars"] += len(text)
                    state["tail"] = 0
                    state["examples"] += 1
            if state is not None:
                yield finished(current, state)

        def finished(conv_id, s):
            return (conv_id, s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"] + s["tail"], s["examples"])

        return _batches(rows(), schema)

    ordered = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_examples long",
    )
