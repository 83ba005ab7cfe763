"""From `documents` to packed training sequences: quality rules, exact dedup, near dedup, source mixing, packing.

Each stage reads all rows that the one before kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from seqloom.llm.queries import table, tokenizer_path
from seqloom.session import cut_lineage, default_shared_folder


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that every quality rule passes, with their columns; null text counts as empty and goes. Rows with equal or
    null ids keep their own verdicts. No rows give no rows."""
    default_shared_folder(spark)
    return quality_rules.kept_documents(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space that with the smallest id, once if the row is repeated. A null id stays only
    where a group has no other; null and empty texts are equal to each other. Different texts under one id all stay."""
    default_shared_folder(spark)
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a weighted Jaccard similarity of 0.8 or more: that with the smallest id. Texts without
    shingles are linked to equal ones alone. Rows that share an id are known by id and text."""
    default_shared_folder(spark)
    return near_dedup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says, by a hash of the id, or of the text where it is null. A null source is a
    source; empty texts follow the rate of their source."""
    default_shared_folder(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; null or empty text is the end token alone. Rows with equal or null
    ids are documents of their own. No rows give no pieces."""
    default_shared_folder(spark)
    return packing.pack(docs, packing.word_encoder(tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

# Near-duplicate sampling and the tokenizer cannot be stated in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
