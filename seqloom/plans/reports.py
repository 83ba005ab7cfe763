"""Measured comparisons: the same result under different physical strategies."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.operators.enrich import enrich
from seqloom.operators.kcore import kcore
from seqloom.operators.sequences import loo_report, loo_split
from seqloom.plans.inspect import exchange_count, join_nodes
from seqloom.schemas import ITEM, USER
from seqloom.session import conf_scope, cut_lineage
from seqloom.sources.writers import discard


def seconds_for(action: Callable[[], object]) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def discard_and_count(df: DataFrame, *counts: Column) -> tuple[int, ...]:
    """Run `df` once, dropping its rows; the counts are made by the same run."""
    seen = Observation()
    discard(df.observe(seen, *[count.alias(f"c{n}") for n, count in enumerate(counts)]))
    return tuple(seen.get[f"c{n}"] for n in range(len(counts)))


def kcore_strategies(df: DataFrame, k: int, strategies: Sequence[str], max_rounds: int | None = None) -> DataFrame:
    """Rows and seconds of every k-core round under each strategy, all from the same stored edge table."""
    df = cut_lineage(df.select(USER, ITEM))
    rows = []
    for strategy in strategies:
        core = kcore(df, k, max_rounds, strategy, partial=True)
        rows += [(strategy, *entry) for entry in core.trace]
        core.release()
    return df.sparkSession.createDataFrame(rows, "strategy STRING, round INT, rows BIGINT, seconds DOUBLE")


def enrich_strategies(
    interactions: DataFrame,
    items: DataFrame,
    strategies: Sequence[str] = ("merge", "broadcast", "reduced_broadcast"),
    broadcast_limit: int | None = None,
) -> DataFrame:
    """Join operator and seconds of each strategy over full-width rows.

    Automatic broadcast is off meanwhile, so the strategy alone decides. A failed strategy keeps its row, with its
    error. `rows` and `matched` describe the joined result, `speed_up` is the slowest strategy's time over this one's.
    Interactions that take a shuffle are stored first, so the seconds are those of the join, and each join runs once.
    """
    spark = interactions.sparkSession
    if exchange_count(interactions):
        interactions = cut_lineage(interactions)
    limit = {} if broadcast_limit is None else {"broadcast_limit": broadcast_limit}
    rows = []
    with conf_scope(spark, spark__sql__autoBroadcastJoinThreshold=-1):
        for strategy in strategies:
            node, seconds, error, found = None, None, None, (None, None)
            try:
                joined = enrich(interactions, items, strategy, **limit)
                node = join_nodes(joined)[0]
                started = time.perf_counter()
                found = discard_and_count(joined, F.count(F.lit(1)), F.count("title"))
                seconds = time.perf_counter() - started
            except Exception as problem:  # a failing strategy is a finding of this report
                error = str(problem)
            rows.append((strategy, node, seconds, error, *found))
    slowest = max((row[2] for row in rows if row[2]), default=None)
    rows = [(*row, slowest / row[2] if row[2] else None) for row in rows]
    schema = "strategy STRING, join_node STRING, seconds DOUBLE, error STRING, rows BIGINT, matched BIGINT, speed_up DOUBLE"
    return spark.createDataFrame(rows, schema)


def adaptive_comparison(clean: DataFrame, order: Sequence[bool] = (False, True)) -> DataFrame:
    """The leave-one-out split with adaptive execution off and on, in the given order: counts and seconds."""
    spark = clean.sparkSession
    rows = []
    for adaptive in order:
        with conf_scope(spark, spark__sql__adaptive__enabled=str(adaptive).lower()):
            started = time.perf_counter()
            counts = loo_report(loo_split(clean)).first()
            seconds = time.perf_counter() - started
        rows.append((adaptive, counts["train"], counts["valid"], counts["test"], counts["users"], seconds))
    schema = "adaptive BOOLEAN, train BIGINT, valid BIGINT, test BIGINT, users BIGINT, seconds DOUBLE"
    return spark.createDataFrame(rows, schema)


def repeat_cost(df: DataFrame, actions: int = 2) -> DataFrame:
    """Seconds to define a plan against seconds to run it repeatedly, without and with a cache, and the rows it gave. An action
    is one run, which also counts its rows."""
    spark = df.sparkSession

    def action(mode: str, number: int) -> tuple[str, int, float, int]:
        started = time.perf_counter()
        (found,) = discard_and_count(df, F.count(F.lit(1)))
        return mode, number, time.perf_counter() - started, found

    rows = [("plan", 0, seconds_for(lambda: df.select("*")), 0)]
    rows += [action("recompute", i + 1) for i in range(actions)]
    cached = df.persist()
    try:
        rows += [action("cached", i + 1) for i in range(actions)]
    finally:
        cached.unpersist()
    return spark.createDataFrame(rows, "mode STRING, action INT, seconds DOUBLE, rows BIGINT")
