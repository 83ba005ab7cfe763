"""Ingest: required-key filter, deterministic dedup, timestamp normalisation, and the ingest reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.columns import digit_length, event_time, percent, ratio
from seqloom.schemas import CLEAN_COLUMNS, ITEM, ITEM_COLUMNS, USER

RAW_KEY = (USER, ITEM, "timestamp")


def require_keys(df: DataFrame, keys: Sequence[str] = RAW_KEY) -> DataFrame:
    """Rows in which every key is present; as plain null tests, these reach the Parquet scan."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def one_per_key(df: DataFrame, keys: Sequence[str], copies: str | None = None) -> DataFrame:
    """One row per key: the smallest by the remaining columns in their order, so reruns keep the same row.

    The choice is a `min`, which map tasks apply before the shuffle. A key with any number of copies therefore sends
    at most one row per map task. `copies` adds the number of rows the key had.
    """
    rest = [name for name in df.columns if name not in keys]
    survivor = F.min(F.struct(*rest)).alias("_survivor")
    counted = [F.count(F.lit(1)).alias(copies)] if copies else []
    kept = df.groupBy(*keys).agg(survivor, *counted)
    columns = [F.col(name) if name in keys else F.col(f"_survivor.{name}").alias(name) for name in df.columns]
    return kept.select(*columns, *([copies] if copies else []))


def dedup_interactions(df: DataFrame, keys: Sequence[str] = RAW_KEY) -> DataFrame:
    """The same user and item at another time is a different interaction and stays."""
    return one_per_key(df, keys)


def dedup_items(items: DataFrame, item: str = ITEM) -> DataFrame:
    """At most one row per non-null item, also across categories."""
    wanted = [item if name == ITEM else name for name in ITEM_COLUMNS]
    return one_per_key(require_keys(items, [item]), [item]).select(*[c for c in wanted if c in items.columns])


def normalise_time(df: DataFrame) -> DataFrame:
    """Keep epoch milliseconds as `ts_ms` and add the readable `event_ts`."""
    return df.withColumn("ts_ms", F.col("timestamp")).withColumn("event_ts", event_time("timestamp"))


def ingest(raw: DataFrame) -> DataFrame:
    """Raw tagged interactions to clean ones."""
    return normalise_time(dedup_interactions(require_keys(raw))).select(*CLEAN_COLUMNS)


def ingest_report(raw: DataFrame) -> DataFrame:
    """One row of ingest metrics in one pass: the dedup itself counts how many rows each key had."""
    kept = normalise_time(one_per_key(require_keys(raw).select(*RAW_KEY, "category"), RAW_KEY, copies="_copies"))
    totals = kept.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("raw_rows"),
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(USER).alias("users"),
        F.count_distinct(ITEM).alias("items"),
        F.min("ts_ms").alias("min_ts_ms"),
        F.max("ts_ms").alias("max_ts_ms"),
    )
    removed = F.col("raw_rows") - F.col("rows")
    return totals.select(
        "raw_rows",
        "rows",
        removed.alias("removed"),
        percent(removed, F.col("raw_rows")).alias("removed_pct"),
        "users",
        "items",
        ratio(F.col("rows"), F.col("users")).alias("rows_per_user"),
        "min_ts_ms",
        "max_ts_ms",
    )


def clean_report(clean: DataFrame, raw_rows: int) -> DataFrame:
    """The ingest metrics from the clean table and the number of raw rows with all keys, with the time range as times."""
    totals = clean.agg(
        F.lit(raw_rows).cast("bigint").alias("raw_rows"), F.count(F.lit(1)).alias("rows"), F.count_distinct(USER).alias("users"),
        F.count_distinct(ITEM).alias("items"), F.min("event_ts").alias("first_event"), F.max("event_ts").alias("last_event"),
    )
    removed = F.col("raw_rows") - F.col("rows")
    return totals.select(
        "raw_rows", "rows", removed.alias("removed"), percent(removed, F.col("raw_rows")).alias("removed_pct"), "users", "items",
        ratio(F.col("rows"), F.col("users")).alias("rows_per_user"), "first_event", "last_event",
    )


def rows_by(df: DataFrame, key: str, name: str = "rows") -> DataFrame:
    """Row count per key, ordered by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(key)


def timestamp_digits(df: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """How many timestamps have how many characters; milliseconds of this century have 13."""
    return rows_by(df.select(digit_length(ts).alias("digits")), "digits")
