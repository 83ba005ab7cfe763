"""Chronological positions, leave-one-out split and per-user item sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.columns import split_label
from seqloom.operators.ranking import HOT_GROUP_ROWS, ranked
from seqloom.schemas import ITEM, LABELLED_COLUMNS, TS, USER

# Longest item array in one row of user_sequences, unless the caller says otherwise.
CHUNK_ITEMS = 100_000


def sessionize(df: DataFrame, user: str = USER, item: str = ITEM, ts: str = TS, hot_rows: int | None = HOT_GROUP_ROWS) -> DataFrame:
    """Position `pos` of each row in its user's history, ordered by time then item, and the history's `seq_len`."""
    return ranked(df, [user], [ts, item], "pos", "seq_len", hot_rows)


def loo_split(df: DataFrame, user: str = USER, item: str = ITEM, ts: str = TS, hot_rows: int | None = HOT_GROUP_ROWS) -> DataFrame:
    """Leave-one-out labels. The reverse position follows from position and length, so one sort serves both."""
    return loo_labels(sessionize(df, user, item, ts, hot_rows), user, item, ts)


def loo_labels(placed: DataFrame, user: str = USER, item: str = ITEM, ts: str = TS) -> DataFrame:
    """Leave-one-out labels of rows that have their position `pos` and their history's length `seq_len`."""
    placed = placed.withColumn("rev_pos", F.col("seq_len") - F.col("pos") + 1)
    labelled = placed.withColumn("split", split_label(F.col("rev_pos")))
    renamed = {USER: user, ITEM: item, TS: ts}
    wanted = [renamed.get(name, name) for name in LABELLED_COLUMNS]
    return labelled.select(*[name for name in wanted if name in labelled.columns])


def loo_report(labelled: DataFrame, user: str = USER) -> DataFrame:
    """Rows per split, users, and whether there is one test and one validation row per user; one pass."""

    def rows_in(split: str):
        return F.count_if(F.col("split") == split).alias(split)

    counts = labelled.agg(rows_in("train"), rows_in("valid"), rows_in("test"), F.count_distinct(user).alias("users"))
    return counts.select(
        "*",
        (F.col("valid") == F.col("users")).alias("valid_is_users"),
        (F.col("test") == F.col("users")).alias("test_is_users"),
    )


def user_sequences(
    df: DataFrame,
    user: str = USER,
    item: str = ITEM,
    ts: str = TS,
    chunk_items: int = CHUNK_ITEMS,
    hot_rows: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """The ordered items of each user, with `n` items of which `n_train` come before validation and test.

    A row holds `chunk_items` items, a user's last row what is left; `chunk` numbers a user's rows from 0. Readers that
    want whole histories join a user's rows in that order, so no array or aggregation group grows without bound.
    """
    placed = ranked(df.select(user, item, ts), [user], [ts, item], "pos", "n", hot_rows)
    chunk = F.expr(f"(pos - 1) div {chunk_items}")
    chunks = placed.groupBy(F.col(user), chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("pos", item))).alias("_steps"),
        F.max("n").alias("n"),
    )
    items = F.transform("_steps", lambda step: step[item])
    return chunks.select(user, "chunk", items.alias("items"), "n", (F.col("n") - 2).alias("n_train"))


def users_with_rows(df: DataFrame, low: int, high: int, user: str = USER) -> DataFrame:
    """Users having between `low` and `high` rows, with their count."""
    return df.groupBy(user).count().filter(f"count between {low} and {high}")


def example_history(labelled: DataFrame, low: int = 6, high: int = 10, user: str = USER) -> DataFrame:
    """The labelled history of the first user, by id, that has between `low` and `high` rows."""
    first = users_with_rows(labelled, low, high, user).orderBy(user).limit(1).select(user)
    return labelled.join(F.broadcast(first), user, "left_semi").select(*labelled.columns).orderBy("pos")
