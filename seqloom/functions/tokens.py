"""Expressions on semantic-ID tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.schemas import BOS, CODES_PER_LEVEL, EOS, INPUT_LENGTH, LEVEL_OFFSETS, PAD


def code_tokens(codes: Sequence[str], ordinals: int | None = CODES_PER_LEVEL) -> Column:
    """One token per code, each level in its own range; a code outside its range stops the job and names the row.

    The last code numbers the items that share the others, so its range has `ordinals` numbers; None sets it no end.
    """
    in_range = F.lit(True)
    for code in codes[:-1]:
        in_range = in_range & F.col(code).between(0, CODES_PER_LEVEL - 1)
    in_range = in_range & (F.col(codes[-1]) >= 0)
    if ordinals is not None:
        in_range = in_range & (F.col(codes[-1]) < ordinals)
    tokens = F.array(*[(F.col(code) + offset).cast("int") for code, offset in zip(codes, LEVEL_OFFSETS)])
    problem = F.concat(
        F.lit(f"code outside 0..{CODES_PER_LEVEL - 1} in semantic ID "),
        F.concat_ws(",", *[F.col(code).cast("string") for code in codes]),
    )
    return F.when(in_range, tokens).otherwise(F.raise_error(problem).cast("array<int>"))


def with_bos(item_tokens: Column) -> Column:
    """Flatten a list of per-item token lists behind a begin-of-sequence token."""
    return F.concat(F.array(F.lit(BOS)), F.flatten(item_tokens))


def padded(tokens: Column, length: int = INPUT_LENGTH) -> Column:
    """Exactly `length` tokens: cut on the right, or filled with PAD."""
    kept = F.slice(tokens, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(kept)))


def attention_mask(tokens: Column) -> Column:
    """1 for real tokens, 0 for PAD."""
    return F.transform(tokens, lambda token: (token != PAD).cast("int"))


def with_eos(tokens: Column) -> Column:
    return F.concat(tokens, F.array(F.lit(EOS)))


def candidate_id(tokens: Column) -> Column:
    """The four ID tokens of a decoded candidate, with PAD and EOS removed.

    The ordinals 256 and 258 have the numbers of PAD and EOS. In the fourth place they are known by the EOS that follows.
    """
    codes = len(LEVEL_OFFSETS) - 1
    kept = F.filter(tokens, lambda token: ~token.isin(PAD, EOS))
    places = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: ~F.get(tokens, i).isin(PAD, EOS))
    fourth = F.get(places, F.lit(codes - 1)) + 1
    closed = F.get(tokens, fourth).isin(PAD, EOS) & (F.get(tokens, fourth + 1) == EOS)
    whole = F.concat(F.slice(kept, 1, codes), F.array(F.get(tokens, fourth)))
    return F.when(closed, whole).otherwise(F.slice(kept, 1, codes + 1))
