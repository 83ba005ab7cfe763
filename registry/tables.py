"""The provided tables, viewed in the shapes the operators take."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.clean import ingest
from seqloom.operators.quantize import quantize
from seqloom.operators.semantic_ids import semantic_ids
from seqloom.operators.tokens import item_tokens
from seqloom.session import default_shared_folder

LEVELS, K = 3, 160
EPOCH_MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    default_shared_folder(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as interactions of a customer with a part."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        F.col("l_suppkey").alias("asin"),
        F.col("l_partkey").alias("parent_asin"),
        F.col("o_custkey").alias("user_id"),
        F.expr(EPOCH_MILLIS.format("o_orderdate")).alias("timestamp"),
        F.col("l_linenumber").cast("bigint").alias("helpful_vote"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.col("l_returnflag").alias("category"),
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(raw_interactions(spark, sf_dir))


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a second interaction source; the item is inside a JSON field."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("parent_asin"),
        F.expr(EPOCH_MILLIS.format("ts")).alias("ts_ms"),
        F.col("event_type").alias("category"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.array("p_type", F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("description"),
        F.array("p_type", "p_brand").alias("categories"),
        F.col("p_brand").alias("store"),
        F.col("p_type").alias("main_category"),
        F.format_string("%.2f", "p_retailprice").alias("price"),
        (F.col("p_size") / F.lit(10.0)).alias("average_rating"),
        F.col("p_size").cast("bigint").alias("rating_number"),
    )


def items_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item twice, as two categories would bring it."""
    once = items(spark, sf_dir)
    return once.unionByName(once.withColumn("title", F.concat(F.lit("~"), F.col("title"))))


def item_vectors(spark: SparkSession, sf_dir: str, shared: bool = True) -> DataFrame:
    """One vector per item. `shared` spreads the vectors over all items, so that codes collide; otherwise item and
    vector numbers are equal and items beyond the vectors have none."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parent_asin"))
    vec_id = F.col("parent_asin") % F.lit(vectors.count()) if shared else F.col("parent_asin")
    return part.withColumn("vec_id", vec_id).join(vectors, "vec_id").select("parent_asin", "embedding")


def fixed_codebooks(spark: SparkSession, sf_dir: str) -> list[np.ndarray]:
    """Codebooks that SQL can state, from all vectors: level l's centroid c is the mean of what the earlier levels leave of
    the vectors with (vec_id + l * (vec_id div K)) mod K = c. K means per level reach the driver."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    codebooks: list[np.ndarray] = []
    for level in range(LEVELS):
        left = vectors.withColumn("left", F.col("embedding").cast("array<double>"))
        if codebooks:
            left = quantize(vectors, codebooks, residual="left")
        code = F.expr(f"(vec_id + {level} * (vec_id div {K})) % {K}")
        means = left.groupBy(code.alias("code")).agg(Summarizer.mean(array_to_vector("left")).alias("mean"))
        codebooks.append(np.array([row["mean"].toArray() for row in means.orderBy("code").collect()]))
    return codebooks


def coded_items(spark: SparkSession, sf_dir: str, shared: bool = True) -> DataFrame:
    return quantize(item_vectors(spark, sf_dir, shared), fixed_codebooks(spark, sf_dir))


def item_sids(spark: SparkSession, sf_dir: str, shared: bool = True) -> DataFrame:
    return semantic_ids(coded_items(spark, sf_dir, shared))


def tokens_by_item(spark: SparkSession, sf_dir: str, shared: bool = True) -> DataFrame:
    """Every item's tokens, however many items share their codes, as the SQL states them."""
    return item_tokens(item_sids(spark, sf_dir, shared), ordinals=None)
