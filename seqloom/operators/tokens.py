"""Token sequences and next-item examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.tokens import attention_mask, code_tokens, padded, with_bos, with_eos
from seqloom.operators.ranking import HOT_GROUP_ROWS, ranked
from seqloom.operators.semantic_ids import CODES, COLLISION
from seqloom.schemas import BOS, CODES_PER_LEVEL, EOS, HISTORY_ITEMS, INPUT_LENGTH, ITEM, LEVEL_OFFSETS, PAD, TS, USER, VOCAB_SIZE

SPLITS = ("train", "valid", "test")
# Shortest history that has a training, a validation and a test item.
MIN_ITEMS = 3
# Targets per aggregation group; the longest array is this plus the history carried over from the block before.
BLOCK_TARGETS = 1024


def item_tokens(sids: DataFrame, item: str = ITEM, ordinals: int | None = CODES_PER_LEVEL) -> DataFrame:
    """The token list of each item. More than `ordinals` items of equal codes stop the job; None lets any number through, whose
    fourth tokens go on past the vocabulary, so they are told from PAD, BOS and EOS by their place alone."""
    return sids.select(item, code_tokens([*CODES, COLLISION], ordinals).alias("tokens"))


def token_steps(
    interactions: DataFrame,
    tokens: DataFrame,
    user: str = USER,
    item: str = ITEM,
    ts: str = TS,
    hot_rows: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """Interactions as (user, pos, n, item, tokens). Rows whose item has no ID are gone before positions are given."""
    mapped = interactions.select(user, item, ts).join(tokens, item)
    placed = ranked(mapped, [user], [ts, item], "pos", "n", hot_rows)
    return placed.select(user, "pos", "n", item, "tokens")


def split_of_target() -> Column:
    """Which split a position is the target of; the first item of a history is never one."""
    pos, n = F.col("pos"), F.col("n")
    return F.when(pos == n, "test").when(pos == n - 1, "valid").when(pos > 1, "train")


def examples(
    steps: DataFrame,
    splits: Sequence[str] = SPLITS,
    history: int = HISTORY_ITEMS,
    user: str = USER,
    block: int = BLOCK_TARGETS,
) -> DataFrame:
    """(user, t, split, inp, tgt): the tokens of up to `history` items before 0-based position t, and those of item t.

    Histories are cut into blocks of `block` targets. The last `history` steps of a block are also sent to the next,
    so every example is built inside one bounded group and no group holds a whole long history.
    """
    if block < history:
        raise ValueError(f"block must be at least the history length {history}, not {block}")
    steps = steps.filter(F.col("n") >= MIN_ITEMS)
    pos, n = F.col("pos"), F.col("n")
    if "train" not in splits:
        # The last two targets and what precedes them: one small group per user.
        steps = steps.filter(pos >= n - 1 - history)
        blocks = F.array(F.lit(0).cast("bigint"))
        first_target = F.lit(1)
    else:
        own = F.expr(f"(pos - 1) div {block}")
        carried = (pos > (own + 1) * block - history) & (n > (own + 1) * block)
        blocks = F.when(carried, F.array(own, own + 1)).otherwise(F.array(own))
        first_target = F.col("_block") * block + 1
    placed = steps.select(user, "n", F.struct("pos", "tokens").alias("_step"), F.explode(blocks).alias("_block"))
    grouped = placed.groupBy(user, "_block").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list("_step")).alias("_steps")
    )
    lists = F.transform("_steps", lambda step: step["tokens"])
    grouped = grouped.select(user, "n", "_steps", lists.alias("_lists"), first_target.cast("bigint").alias("_first"))

    def example(step: Column, index: Column) -> Column:
        start = F.greatest(index - history, F.lit(0))
        return F.struct(
            step["pos"].alias("pos"),
            F.slice(F.col("_lists"), start + 1, index - start).alias("past"),
            step["tokens"].alias("tgt"),
        )

    made = grouped.select(user, "n", "_first", F.explode(F.transform("_steps", example)).alias("_e"))
    made = made.select(user, "n", "_first", "_e.*").withColumn("split", split_of_target())
    wanted = made.filter((F.col("pos") >= F.col("_first")) & F.col("split").isin(*splits))
    return wanted.select(
        user, (F.col("pos") - 1).alias("t"), "split", with_bos(F.col("past")).alias("inp"), "tgt"
    )


def example_report(steps: DataFrame, all_users: DataFrame, user: str = USER) -> DataFrame:
    """One row: users with examples, users skipped as too short, and examples per split."""
    lengths = steps.filter(F.col("pos") == 1).select(user, "n")
    long_enough = F.col("n") >= MIN_ITEMS
    counts = lengths.agg(
        F.count_if(long_enough).alias("users"),
        F.coalesce(F.sum(F.when(long_enough, F.col("n") - MIN_ITEMS)), F.lit(0)).alias("train"),
    )
    known = all_users.agg(F.count_distinct(user)).first()[0]
    users = F.col("users")
    return counts.select(
        "users",
        (F.lit(known).cast("bigint") - users).alias("skipped"),
        "train",
        users.alias("valid"),
        users.alias("test"),
    )


def model_input(made: DataFrame, length: int = INPUT_LENGTH) -> DataFrame:
    """Fixed-length `input_ids`, the `attention_mask` over them, and the target closed by EOS as `labels`."""
    fixed = made.withColumn("input_ids", padded(F.col("inp"), length))
    keep = [name for name in made.columns if name not in ("inp", "tgt")]
    return fixed.select(
        *keep,
        "input_ids",
        attention_mask(F.col("input_ids")).alias("attention_mask"),
        with_eos(F.col("tgt")).alias("labels"),
    )


def vocabulary(spark: SparkSession, n_items: int) -> DataFrame:
    """The vocabulary descriptor, in one row."""
    row = (VOCAB_SIZE, PAD, BOS, EOS, list(LEVEL_OFFSETS), HISTORY_ITEMS, n_items)
    schema = (
        "vocab_size INT, PAD INT, BOS INT, EOS INT, layer_offsets ARRAY<INT>, max_hist_items INT, n_items BIGINT"
    )
    return spark.createDataFrame([row], schema)
