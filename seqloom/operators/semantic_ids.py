"""Semantic-ID table: codes per item and an ordinal that tells items with equal codes apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ranking import HOT_GROUP_ROWS, ranked
from seqloom.schemas import ITEM

CODES = ("c1", "c2", "c3")
COLLISION = "c_collision"


def semantic_ids(
    coded: DataFrame,
    item: str = ITEM,
    codes: Sequence[str] = CODES,
    hot_rows: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """Spread `codes` into columns and number the items that share all of them from 0, by item."""
    spread = coded.select(item, *[F.get("codes", F.lit(i)).alias(name) for i, name in enumerate(codes)])
    numbered = ranked(spread, list(codes), [item], "_n", hot_rows=hot_rows)
    return numbered.select(item, *codes, (F.col("_n") - 1).cast("int").alias(COLLISION))


def utilisation(sids: DataFrame, k: int, codes: Sequence[str] = CODES) -> DataFrame:
    """Share of each level's codes in use, over all items; one row per level."""
    per_level = sids.select(F.explode(F.array(*[_level_code(i, code) for i, code in enumerate(codes)])).alias("x"))
    used = per_level.select("x.level", "x.code").distinct().groupBy("level").count()
    return used.select("level", (F.col("count") / F.lit(k)).alias("used_share"))


def _level_code(level: int, code: str):
    return F.struct(F.lit(level).alias("level"), F.col(code).alias("code"))


def collision_report(sids: DataFrame, codes: Sequence[str] = CODES) -> DataFrame:
    """One row: items, distinct code tuples, items beyond the first of their tuple, and the largest tuple."""
    per_tuple = sids.groupBy(*codes).count()
    return per_tuple.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("items"),
        F.count(F.lit(1)).alias("combos"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("colliding"),
        F.coalesce(F.max("count"), F.lit(0)).alias("max_per_combo"),
    )
