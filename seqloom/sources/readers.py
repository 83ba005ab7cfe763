"""File scans. Schemas are always given, so fields outside them are never materialised."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.columns import percent
from seqloom.schemas import (
    INTERACTION_SCHEMA,
    ITEM_SCHEMA,
    SEQUENCE_SCHEMA,
    TOKEN_EXAMPLE_SCHEMA,
    USER,
    VALID_ID_SCHEMA,
)
from seqloom.session import cut_lineage


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL that matches columns by name."""
    return reduce(DataFrame.unionByName, frames)


def read_json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def read_interactions(spark: SparkSession, paths_by_category: Mapping[str, str | list[str]]) -> DataFrame:
    """One scan per category, each tagged with its category as a literal."""
    return union_all(
        [
            read_json(spark, paths, INTERACTION_SCHEMA).withColumn("category", F.lit(category))
            for category, paths in paths_by_category.items()
        ]
    )


def read_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Item metadata of all categories in one scan; categories may repeat an item."""
    return read_json(spark, paths, ITEM_SCHEMA)


def read_parquet(spark: SparkSession, path: str, partition_filter: str | None = None) -> DataFrame:
    """Parquet scan; a filter on a partition column skips whole directories."""
    df = spark.read.parquet(path)
    return df.filter(partition_filter) if partition_filter else df


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, SEQUENCE_SCHEMA)


def read_token_examples(spark: SparkSession, path: str, split: str, max_examples: int | None = None) -> DataFrame:
    """Examples of one split; the optional cap keeps the first by user and position, whatever the file order."""
    examples = (
        spark.read.schema(f"{TOKEN_EXAMPLE_SCHEMA}, split STRING").json(path).filter(F.col("split") == split)
    )
    return examples.orderBy(USER, "t").limit(max_examples) if max_examples is not None else examples


def read_valid_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, VALID_ID_SCHEMA)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Row sample without replacement; which rows are kept depends on the partition layout."""
    return df if fraction >= 1.0 else df.sample(withReplacement=False, fraction=fraction, seed=seed)


def user_sample(df: DataFrame, kept: int, buckets: int = 100, user: str = USER) -> DataFrame:
    """Every row of the users whose hash falls in the first `kept` of `buckets`: repeatable, whole sequences."""
    return df.filter(F.pmod(F.hash(user), F.lit(buckets)) < kept)


def row_hash_sample(df: DataFrame, fraction: float, keys: list[str], seed: str = "sample") -> DataFrame:
    """The rows whose keys' digest falls below `fraction`, whatever the partition layout; a null key counts as empty."""
    named = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys])
    unit = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.filter(unit < fraction)


CORRUPT = "_corrupt_record"


def read_json_checked(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of well-formed lines, and a quarantine of the others: file, record.

    A line is malformed if it is no JSON object, or if a field does not fit its type. It is in the quarantine alone, whole, and
    never among the rows. The lines are parsed once and stored, as both results read them.
    """
    parsed = spark.read.schema(f"{schema}, {CORRUPT} STRING").option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    stored = cut_lineage(parsed.withColumn("_file", F.col("_metadata.file_path")))
    rows = stored.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file")
    return rows, stored.filter(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("record"))


def read_interactions_checked(
    spark: SparkSession, paths_by_category: Mapping[str, str | list[str]], schema: str = INTERACTION_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """`read_interactions` with malformed lines in a quarantine of their own (category, file, record)."""
    rows, bad = [], []
    for category, paths in paths_by_category.items():
        good, malformed = read_json_checked(spark, paths, schema)
        rows.append(good.withColumn("category", F.lit(category)))
        bad.append(malformed.select(F.lit(category).alias("category"), "file", "record"))
    return union_all(rows), union_all(bad)


def quarantine_report(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """category, rows, malformed and their share in percent, also of categories that have only one kind."""
    kinds = [
        df.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("malformed", F.lit(flag))
        for df, flag in ((rows, False), (bad, True))
    ]
    counts = union_all(kinds).groupBy("category").agg(
        F.coalesce(F.sum(F.when(~F.col("malformed"), F.col("n"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("malformed"), F.col("n"))), F.lit(0)).alias("malformed"),
    )
    return counts.withColumn("malformed_pct", percent(F.col("malformed"), F.col("rows") + F.col("malformed")))
