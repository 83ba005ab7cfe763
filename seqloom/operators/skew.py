"""Measurements of key skew and partition skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.schemas import ITEM

PERCENTILE_ACCURACY = 10_000


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count()


def distribution(counts: DataFrame, column: str = "count") -> DataFrame:
    """Median, 95th and 99th percentile, minimum, mean and maximum of a count column, in one row."""
    summary = counts.selectExpr(
        f"percentile_approx({column}, array(0.5, 0.95, 0.99), {PERCENTILE_ACCURACY}) as p",
        f"min({column}) as min",
        f"avg({column}) as avg",
        f"max({column}) as max",
        f"stddev({column}) as stddev",
    )
    return summary.selectExpr("p[0] as p50", "p[1] as p95", "p[2] as p99", "min", "avg", "max", "stddev")


def key_skew(df: DataFrame, key: str) -> DataFrame:
    """Distribution of rows per key value."""
    return distribution(rows_per_key(df, key)).drop("stddev")


def hot_keys(df: DataFrame, key: str = ITEM, n: int = 5) -> DataFrame:
    """The `n` keys with the most rows; equal counts go by key."""
    return rows_per_key(df, key).orderBy(F.desc("count"), key).limit(n)


def partition_rows(df: DataFrame, key: str, partitions: int, shuffle: bool = False) -> DataFrame:
    """Rows that each partition gets when `df` is hash-partitioned by `key`.

    The partition is a function of the key, so the rows are counted where they are: measuring a skewed layout does not
    need to build it. `shuffle=True` does move the rows and reads the partition number from the running task.
    """
    if shuffle:
        numbered = df.repartition(partitions, key).select(F.spark_partition_id().alias("pid"))
    else:
        numbered = df.select(F.pmod(F.hash(key), F.lit(partitions)).alias("pid"))
    return numbered.groupBy("pid").count()


def partition_skew(
    df: DataFrame, key: str, partitions: int, include_empty: bool = False, shuffle: bool = False
) -> DataFrame:
    """Distribution of rows per partition and the imbalance max / avg. Empty partitions count only if asked for."""
    rows = partition_rows(df, key, partitions, shuffle)
    if include_empty:
        every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("pid"))
        rows = every.join(rows, "pid", "left").select("pid", F.coalesce("count", F.lit(0)).alias("count"))
    return distribution(rows).withColumn("imbalance", F.col("max") / F.greatest(F.col("avg"), F.lit(1.0)))
