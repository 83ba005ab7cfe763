"""Mixing sources to target weights by repetition rates, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import WORD, text_or_empty
from seqloom.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
MAX_RATE = 2
SEED = "mix"


def n_words(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def unit_interval(seed: str, *keys: str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone: the first 32 bits of an MD5 digest."""
    parts = [F.lit(seed), *[F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys]]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def drawn_by(key: str, text: str) -> Column:
    """What decides for a document: its key, or without one the digest of its text."""
    return F.coalesce(F.col(key).cast("string"), F.md5(text_or_empty(text).cast("binary")))


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size", weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = SHARE, max_rate: int = MAX_RATE,
) -> DataFrame:
    """Per source: `source_size`, `target` and `rate` (target over size).

    Sources in code-point order, null last, take the weights in turn and share `share` times all sizes. A target stops
    at `max_rate` times its source's size and the excess goes to the others by weight, until none is above: with the
    sources ordered by cap over weight, the capped ones are a prefix, and the first prefix after which nothing else
    exceeds its cap is the answer. The sums run over one row per source.
    """
    per_source = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = per_source.withColumn("weight", weight.cast("long"))
    everything = Window.partitionBy(F.lit(1))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share[0]) / F.lit(float(share[1]))
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(max_rate)
    level = (total - capped) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("cap", F.col("source_size") * F.lit(max_rate))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    first_fit = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    shared = F.col("weight") * F.coalesce(first_fit, F.lit(0.0))
    uncapped = first_fit.isNotNull() & (shared <= F.col("cap"))
    target = F.when(uncapped, shared).otherwise(F.col("cap").cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def with_copies(rows: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """`rows` plus their source's `source_size` and `target`, and `copies`: floor(rate), plus one if the hash of the
    key falls below the rate's fraction. The targets have one row per source; Spark broadcasts them if their size allows."""
    named = targets.select(
        F.col("source").alias("_source"), "source_size", "target", F.col("rate").alias("_rate")
    )
    extra = (unit_interval(seed, key) < F.col("_rate") - F.floor("_rate")).cast("long")
    clashing = [name for name in ("source_size", "target", "copies") if name in rows.columns]
    return (
        rows.drop(*clashing).join(named, F.col(source).eqNullSafe(F.col("_source")), "left")
        .withColumn("copies", F.floor("_rate") + extra).drop("_source", "_rate")
    )


def mixed_sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **targets) -> DataFrame:
    """Per row of `docs`: key, source, size in words, its source's size and target, and how many copies the mix takes.

    Rows with the same key take the same decision; without a key, rows with the same text do. Null text has size 0, a source
    of size 0 has target 0 and its rows no copies. No rows give no rows. Texts are read once; the sizes are stored.
    """
    sizes = cut_lineage(docs.select(F.col(key), F.col(source), n_words(text).alias("size"), drawn_by(key, text).alias("_drawn")))
    return with_copies(sizes, source_targets(sizes, source, **targets), "_drawn", source).drop("_drawn")


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **targets) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`."""
    sizes = cut_lineage(docs.select(F.col(source).alias("source"), n_words(text).alias("size")))
    goals = cut_lineage(source_targets(sizes, **targets))
    taken = with_copies(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                                    drawn_by(key, text).alias("_key"), F.col(source).alias("_from")), goals, "_key", "_from")
    return taken.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
