"""Popularity recommender and ranked-list metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import discount
from seqloom.functions.tokens import candidate_id
from seqloom.schemas import ITEM, USER

MIN_ITEMS = 3


def popularity_topk(labelled: DataFrame, k: int = 10, item: str = ITEM) -> DataFrame:
    """The `k` items with the most training rows and their 0-based rank; equal counts go by item."""
    train = labelled.filter(F.col("split") == "train").groupBy(item).agg(F.count(F.lit(1)).alias("rows"))
    top = train.orderBy(F.desc("rows"), item).limit(k)
    # The window runs over k rows.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rows"), item)) - 1)


def test_targets(labelled: DataFrame, max_users: int | None = None, user: str = USER, item: str = ITEM) -> DataFrame:
    """The test item of each user with at least three rows; the optional cap keeps the first users by id."""
    targets = labelled.filter((F.col("split") == "test") & (F.col("pos") >= MIN_ITEMS)).select(user, item)
    return targets.orderBy(user).limit(max_users) if max_users is not None else targets


def metrics(ranks: DataFrame, ks: Sequence[int], rank: str = "rank") -> DataFrame:
    """(k, users, recall, ndcg) from one row per user with the 0-based rank of the hit, NULL for a miss.

    With one relevant item per user, recall is the hit rate. No users give NULL metrics.
    """
    parts = []
    for k in ks:
        hit = F.col(rank).isNotNull() & (F.col(rank) < k)
        parts.append(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias(f"recall_{k}"))
        parts.append(F.avg(F.when(hit, discount(F.col(rank))).otherwise(0.0)).alias(f"ndcg_{k}"))
    wide = ranks.agg(F.count(F.lit(1)).alias("users"), *parts)
    rows = [
        F.struct(F.lit(k).alias("k"), "users", F.col(f"recall_{k}").alias("recall"), F.col(f"ndcg_{k}").alias("ndcg"))
        for k in ks
    ]
    return wide.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def evaluate(
    truth: DataFrame, candidates: DataFrame, ks: Sequence[int], key: str = ITEM, user: str = USER
) -> DataFrame:
    """Metrics of per-user ranked candidates (user, key, rank) against one true key per user; the first match counts."""
    first = candidates.groupBy(user, key).agg(F.min("rank").alias("rank"))
    return metrics(truth.join(first, [user, key], "left"), ks)


def evaluate_shared(truth: DataFrame, top: DataFrame, ks: Sequence[int], key: str = ITEM) -> DataFrame:
    """Metrics when every user gets the same ranked list, whose length is the recommender's k."""
    return metrics(truth.join(F.broadcast(top.select(key, "rank")), key, "left"), ks)


def decoded(candidates: DataFrame, column: str = "tokens") -> DataFrame:
    """Decoded token strings reduced to the four tokens of an ID."""
    return candidates.withColumn(column, candidate_id(F.col(column)))


def tokens_to_items(candidates: DataFrame, tokens: DataFrame, item: str = ITEM) -> DataFrame:
    """The item of each candidate ID, NULL where no item has it."""
    return candidates.join(tokens.select("tokens", item), "tokens", "left")


def compare(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Model and baseline metrics side by side, with model / baseline; NULL where the baseline is zero."""
    joined = model.alias("m").join(baseline.alias("b"), "k")

    def pair(name: str):
        mine, other = F.col(f"m.{name}"), F.col(f"b.{name}")
        return [
            mine.alias(f"model_{name}"),
            other.alias(f"baseline_{name}"),
            F.try_divide(mine, other).alias(f"{name}_ratio"),
        ]

    return joined.select("k", *pair("recall"), *pair("ndcg"))
