import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example int, segment string"
PIECES = st.lists(st.sampled_from([*chat.CONTROL_STRINGS, "\\", ".", "n", "<", ">", "s", "/", "[", "INST]", "\n", "é", " "]), max_size=12).map("".join)


@given(PIECES, PIECES, PIECES)
@settings(max_examples=300, deadline=None)
def test_any_text_reads_back_and_holds_no_control_string(role, text, more):
    piece, start, end = chat.render_turn(role, text)
    body = piece[start:end]
    assert not any(mark in body for mark in chat.CONTROL_STRINGS)
    assert chat.unescape(body) == text
    assert chat.read_turns(piece + chat.render_turn(more, role)[0]) == [(role, text), (more, role)]


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] hi"), (1, 2, "assistant", "a\\b"), (1, 3, "user", ""), (1, 4, "assistant", None),
    (1, 5, "user", "bye"), (2, 0, "user", "only"), (3, 0, "assistant", "first"), (3, 1, "assistant", "second"), (None, 0, "user", "q"),
    (None, 1, "assistant", "r"), (4, None, None, "x"), (4, 2, "user", "tie b"), (4, 2, "user", "tie a"), (4, 3, "assistant", "<s>" * 5),
    (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "assistant", "z"),
]


def rows(spark, data=ROWS):
    return spark.createDataFrame([(*row, 1, "clash") for row in data], SCHEMA)


def conversations():
    grouped = defaultdict(list)
    for key, turn, role, text in ROWS:
        grouped[key].append((turn is not None, turn or 0, role or "", text or ""))
    return {key: [(r, t) for _, _, r, t in sorted(turns)] for key, turns in grouped.items()}


@pytest.mark.parametrize("segment_chars", [1, chat.SEGMENT_CHARS])
def test_read_back(spark, segment_chars):
    got = {r["conv_id"]: r for r in chat.read_back(chat.prefix_examples(rows(spark), segment_chars=segment_chars)).collect()}
    expected = conversations()
    assert set(got) == set(expected)
    for key, turns in expected.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[key]["n_turns"] == len(turns)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[key]["n_examples"] == sum(r == "assistant" for r, _ in turns)


@pytest.mark.parametrize("segment_chars", [1, chat.SEGMENT_CHARS])
def test_every_reply_is_an_example_with_all_turns_before(spark, segment_chars):
    examples = defaultdict(list)
    for row in chat.expanded(chat.prefix_examples(rows(spark), segment_chars=segment_chars)).orderBy("example").collect():
        examples[row["conv_id"]].append((chat.read_turns(row["text"]), chat.unescape(row["text"][row["loss_start"] : row["loss_end"]])))
    for key, turns in conversations().items():
        assert examples[key] == [(turns[: n + 1], t) for n, (r, t) in enumerate(turns) if r == "assistant"]


def test_rows_of_examples_hold_their_whole_text(spark):
    """The examples themselves, not what is made of them later, hold context and reply; a wrong context is found."""
    made = chat.prefix_examples(rows(spark), segment_chars=30)
    texts = defaultdict(list)
    for row in made.filter("loss_start is not null").orderBy("example").collect():
        assert row["text"][row["context_chars"] :].startswith("<s>")
        texts[row["conv_id"]].append(row["text"])
    for key, turns in conversations().items():
        pieces = [chat.render_turn(role, text)[0] for role, text in turns]
        assert texts[key] == ["".join(pieces[: n + 1]) for n, (role, _) in enumerate(turns) if role == "assistant"]
    with pytest.raises(Exception, match="context of an example"):
        changed = F.replace("text", F.lit("be kind"), F.lit("be blind"))
        chat.read_back(made.withColumn("text", F.when(F.col("context_turns") > 2, changed).otherwise(F.col("text")))).collect()


def test_no_rows(spark):
    assert chat.read_back(chat.prefix_examples(rows(spark, []))).count() == 0


def test_lengths_do_not_depend_on_the_size_of_segments(spark):
    """A long run of turns without a reply takes rows of its own, which belong to the contexts of later examples."""
    turns = [(1, n, "user" if n % 5 else "assistant", f"turn {n} " * (n + 1)) for n in range(1, 13)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole, parts = (chat.read_back(chat.prefix_examples(rows, segment_chars=size)).first() for size in (1 << 20, 10))
    sizes = [len(chat.render_turn(role, text)[0]) for _, _, role, text in turns]
    assert whole == parts and whole["formatted_chars"] == sum(sizes[:5]) + sum(sizes[:10]) + sum(sizes[10:])
