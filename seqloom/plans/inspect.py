"""Questions about a DataFrame's physical plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

JOIN_NODE = re.compile(r"\b(\w*(?:HashJoin|MergeJoin|NestedLoopJoin|CartesianProduct))\b")


def physical_plan(df: DataFrame) -> str:
    """The plan as text, before adaptive execution changes it."""
    return df._jdf.queryExecution().executedPlan().toString()


def join_nodes(df: DataFrame) -> list[str]:
    """Join operators, outermost first."""
    return JOIN_NODE.findall(physical_plan(df))


def exchange_count(df: DataFrame) -> int:
    """Shuffles in the plan; reused and broadcast exchanges are not counted."""
    return len(re.findall(r"(?<!\w)Exchange (?:hash|range|round|single)", physical_plan(df)))


def partition_count(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def schema_listing(df: DataFrame) -> DataFrame:
    """Column names and types, in order."""
    rows = [(i, field.name, field.dataType.simpleString()) for i, field in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position INT, name STRING, type STRING")


def executed_plan(df: DataFrame):
    """The plan that ran, in its last adaptive form; `df` must have been executed itself, by `collect` or `discarded`."""
    plan = df._jdf.queryExecution().executedPlan()
    return plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan


def _walk(node, depth: int = 0):
    """Nodes of an executed plan with their depth; a query stage is followed by the plan that it ran."""
    yield node, depth
    name = node.nodeName()
    if name.endswith("QueryStage"):
        yield from _walk(node.plan(), depth + 1)
    children = node.children()
    for n in range(children.size()):
        yield from _walk(children.apply(n), depth + 1)


def executed_nodes(df: DataFrame) -> list[str]:
    """Names of the executed plan's nodes, outermost first, without the nodes that only wrap others."""
    wrapping = ("InputAdapter", "WholeStageCodegen")
    return [node.nodeName() for node, _ in _walk(executed_plan(df)) if not node.nodeName().startswith(wrapping)]


def exchange_report(df: DataFrame) -> DataFrame:
    """One row per shuffle that `df` ran: its number, how it deals rows, map tasks' output in bytes (all, largest and mean
    partition), partitions, tasks that read them after adaptive execution, and skew, the largest by the mean.

    A repartition by an expression whose few rows were read by one task shows as tasks = 1, whatever its partitions.
    """
    readers, rows, schema = {}, [], (
        "exchange INT, dealt_by STRING, bytes BIGINT, partitions INT, tasks INT, max_bytes BIGINT, mean_bytes DOUBLE, skew DOUBLE"
    )
    for node, _ in _walk(executed_plan(df)):
        if node.nodeName() == "AQEShuffleRead":
            readers[node.child().id()] = node.partitionSpecs().size()
        if node.nodeName() != "ShuffleQueryStage":
            continue
        statistics = node.mapStats()
        sizes = [int(n) for n in statistics.get().bytesByPartitionId()] if statistics.isDefined() else []
        exchange = node.shuffle()
        partitions = exchange.numPartitions()
        mean = sum(sizes) / max(len(sizes), 1)
        rows.append((
            len(rows), exchange.outputPartitioning().toString().split("(")[0], sum(sizes), partitions,
            readers.get(node.id(), partitions), max(sizes, default=0), mean, max(sizes, default=0) / mean if mean else 0.0,
        ))
    return df.sparkSession.createDataFrame(rows, schema)


def partition_filters(df: DataFrame) -> str:
    """The conditions by which file scans skip directories."""
    return " ".join(re.findall(r"PartitionFilters: \[(.*?)\], (?:PushedFilters|Push)", df._jdf.queryExecution().toString(), re.S))
