"""Iterative k-core: keep users and items that have at least k rows among the kept rows."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import percent, ratio, value_bytes
from seqloom.operators.clean import require_keys
from seqloom.operators.enrich import payload_bytes
from seqloom.operators.peel import peeled
from seqloom.operators.ranking import HOT_GROUP_ROWS, find_hot, split_hot, store_with_hot
from seqloom.plans.inspect import exchange_count
from seqloom.schemas import ITEM, USER
from seqloom.session import StoredTables, conf_scope, cut_lineage, drop_stored
from seqloom.sources.readers import union_all

# Strategies that go round by round; `peel` is the other one.
STRATEGIES = ("delta", "table", "persist", "recompute")
# Strategies whose intermediate results are tables in the shared folder.
STORING = ("delta", "table", "peel")
# While losses are followed, the edge table is rewritten once fewer than this share of its rows is left.
REWRITE_SHARE = 0.5
# Keys that a join broadcasts, in bytes of their values: two million numbers, some 100 MB as a hash table.
KEYS_LIMIT_BYTES = 16 * 1024 * 1024
# What a row of losses counts for under this limit, before its keys are known.
LOSS_BYTES = 64
# Rows of losses that an exchange of them has a partition for.
TASK_ROWS = 100_000


@dataclass
class KCore:
    """Surviving rows, the trace (round, or exchange when peeling, rows, seconds) and whether the fixpoint was reached."""

    rows: DataFrame
    trace: list[tuple[int, int, float]]
    converged: bool
    cached: list[DataFrame] = field(default_factory=list)
    tables: StoredTables | None = None

    @property
    def rounds(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(self.trace, "round INT, rows BIGINT, seconds DOUBLE")

    def release(self) -> None:
        """Give up the caches and stored tables that `rows` reads."""
        for df in self.cached:
            df.unpersist()
        if self.tables:
            self.tables.release()


class NotConverged(RuntimeError):
    """A round limit ended the search before the fixpoint."""


def kcore(
    df: DataFrame,
    k: int,
    max_rounds: int | None = None,
    strategy: str = "delta",
    user: str = USER,
    item: str = ITEM,
    hot_rows: int = HOT_GROUP_ROWS,
    partial: bool = False,
) -> KCore:
    """Each round drops users with fewer than k rows, then items with fewer than k of the rows left.

    It stops when a round leaves the row count unchanged. If that has not happened after `max_rounds`, NotConverged is
    raised; with `partial` the rows of the last round are returned instead, with `converged=False`. Only a two-column edge
    table goes through the rounds; the wide rows are joined once at the end, and stored first if they take a shuffle.

    Strategies differ in what a round costs, never in its result:
    `recompute` keeps nothing between rounds and runs every earlier round again; `persist` caches the edges that a round
    leaves and frees those of the one before; `table` writes them to the shared folder. These three count all rows in the
    first round and then what keys have lost; the rows stay where they are. `delta` writes the edges of the first round,
    counted by windows, then leaves the edge table as it is and follows losses, so that a round with few removals is two
    scans without a shuffle of edges; `peel` runs many rounds in one, see `operators.peel`: its trace lists exchanges
    instead of rounds, always to the fixpoint, so it takes no round limit.

    With keys of more than `hot_rows` rows, the first round of `delta` leaves the rows where they are, too.
    """
    if strategy not in (*STRATEGIES, "peel"):
        raise ValueError(f"strategy must be peel or one of {STRATEGIES}, not {strategy!r}")
    if strategy == "peel" and max_rounds is not None:
        raise ValueError("peel has no rounds to limit")
    with StoredTables(df.sparkSession) as tables:
        core = _kcore(df, k, max_rounds, strategy, user, item, hot_rows)
    core.tables = tables
    if not core.converged and not partial:
        core.release()
        raise NotConverged(f"{len(core.trace)} rounds did not reach the {k}-core")
    return core


def _kcore(
    df: DataFrame, k: int, max_rounds: int | None, strategy: str, user: str, item: str, hot_rows: int
) -> KCore:
    if strategy in STORING and exchange_count(df):
        # The edges and the final join both read the rows; what needs shuffles to compute is computed once.
        df, found = store_with_hot(df, [[user], [item]], hot_rows)
    else:
        found = [find_hot(df, [key], hot_rows) for key in (user, item)]
    hot = dict(zip((user, item), found))
    edges = require_keys(df.select(user, item), [user, item])
    if strategy == "peel":
        users, items, trace = peeled(edges, k, user, item, hot[user])
        return KCore(_between(df, users, items, user, item, hot), trace, True)
    trace: list[tuple[int, int, float]] = []
    # The edges that the last round left, where a strategy keeps them, and the tables of the last replay.
    kept: DataFrame | None = None
    replay: StoredTables | None = None
    previous, converged = None, False
    losses: _Losses | None = None
    while max_rounds is None or len(trace) < max_rounds:
        started = time.perf_counter()
        if strategy == "delta" and losses is not None and losses.rows < REWRITE_SHARE * losses.stored_rows:
            kept, edges, losses = losses.edges, losses.remaining(), None
        elif losses is None and (strategy != "delta" or previous):
            losses = _Losses(edges, k, hot) if strategy != "recompute" else None
        if strategy == "recompute":
            if replay is not None:
                replay.release()
            losses, replay = _replayed(edges, len(trace) + 1, k, hot)
            rows = losses.rows
        elif losses is not None:
            rows = losses.advance()
            if strategy == "table" and rows != previous:
                before = losses.go_on_with(cut_lineage(losses.remaining()))
                drop_stored(before)
            elif strategy == "persist" and rows != previous:
                before, kept = kept, losses.remaining().persist()
                kept.count()
                losses.go_on_with(kept)
                if before is not None:
                    before.unpersist()
        else:
            edges = cut_lineage(_full_round(edges, k, hot))
            if kept is not None:
                drop_stored(kept)
            kept = edges
            rows = edges.count()
        trace.append((len(trace) + 1, rows, time.perf_counter() - started))
        if rows == previous:
            converged = True
            break
        previous = rows
    cached = [kept] if strategy == "persist" and kept is not None else []
    if strategy == "table" and losses is not None and any(table is not None for table in hot.values()):
        return KCore(losses.among_remaining(df), trace, converged)
    users, items = losses.survivors() if losses is not None else (edges.select(key).distinct() for key in (user, item))
    users, items = cut_lineage(users), cut_lineage(items)
    if replay is not None:
        replay.release()
    return KCore(_between(df, users, items, user, item, hot), trace, converged, cached)


def _between(df: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str, hot: dict) -> DataFrame:
    """The rows between surviving users and items: all of the core, as rows go only when one of their ends goes."""
    kept = _among(_among(df, users, user, hot[user]), items, item, hot[item])
    return kept.select(*df.columns)


def _full_round(edges: DataFrame, k: int, hot: dict[str, DataFrame | None]) -> DataFrame:
    """One round. Without hot keys it reads `edges` once, so the plan of n rounds on top of each other has n rounds; a join of
    the edges with their own counts would double it with every key. With hot keys the rows stay where they are."""
    if any(table is not None for table in hot.values()):
        losses = _Losses(edges, k, hot)
        losses.advance()
        return losses.remaining()
    for key in hot:
        rows = F.count(F.lit(1)).over(Window.partitionBy(key))
        edges = edges.withColumn("_rows", rows).filter(F.col("_rows") >= k).drop("_rows")
    return edges


def _replayed(edges: DataFrame, rounds: int, k: int, hot: dict[str, DataFrame | None]) -> tuple[_Losses, StoredTables]:
    """The state after so many rounds, all of them run now on `edges` from the first count on, and the tables it reads."""
    with StoredTables(edges.sparkSession) as tables:
        losses = _Losses(edges, k, hot)
        for _ in range(rounds):
            losses.advance()
    return losses, tables


def _among(
    rows: DataFrame, keys: DataFrame, key: str, hot: DataFrame | None, how: str = "left_semi", size: int | None = None
) -> DataFrame:
    """Rows whose key is in the stored table `keys` of `size` bytes, or with `left_anti` is not.

    Rows stay where they are if `keys` is small and so broadcast; else those of hot keys do, by a broadcast of the few hot keys
    in it. Where even the hot keys are too many for that, adaptive execution splits the partitions of the largest, as `keys` is
    no aggregate.
    """
    if size is None and hot is not None:
        size = payload_bytes(keys)
    if size is not None and size <= KEYS_LIMIT_BYTES:
        return rows.join(F.broadcast(keys), key, how)
    if hot is None:
        return rows.join(keys, key, how)
    if payload_bytes(hot) > KEYS_LIMIT_BYTES:
        return rows.join(keys, key, how)
    ordinary, large = split_hot(rows, [key], hot)
    ordinary_keys, large_keys = split_hot(keys, [key], hot)
    return ordinary.join(ordinary_keys, key, how).unionByName(large.join(F.broadcast(large_keys), key, how))


class _Losses:
    """Rounds that leave the rows where they are: small tables say which keys are gone and what the others have left.

    All rows are counted in the first round, and later only those that go. A row goes with the first of its ends, so no loss is
    counted twice.
    """

    def __init__(self, edges: DataFrame, k: int, hot: dict[str, DataFrame | None]) -> None:
        self.edges, self.k, self.hot = edges, k, hot
        self.user, self.item = hot
        # Tables of the rows that keys have left: first of all keys, then of those that lost some. A key's least number holds.
        self.left: dict[str, list[DataFrame]] = {key: [] for key in hot}
        # The keys that the last of these tables shows to be too weak, with their size and their rows.
        self.weak: dict[str, tuple[DataFrame, int, int] | None] = dict.fromkeys(hot)
        # Tables of the keys that are gone, with their sizes.
        self.gone: dict[str, list[tuple[DataFrame, int]]] = {key: [] for key in hot}
        # How many of the tables of gone keys are older than the edge table, which has no rows of those keys.
        self.applied = dict.fromkeys(hot, 0)
        self.rows = self.stored_rows = self._note(self.user, self._counts(edges, self.user))

    def advance(self) -> int:
        """One round; returns the row count after it."""
        self._remove(self.user)
        if self.left[self.item]:
            self._lose(self.item, self.user)
        else:
            self._note(self.item, self._counts(self.remaining(), self.item))
        self._remove(self.item)
        self._lose(self.user, self.item)
        return self.rows

    def _counts(self, edges: DataFrame, key: str, name: str = "_left") -> DataFrame:
        return edges.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    def _note(self, key: str, left: DataFrame) -> int:
        """Store what keys have left; the same pass finds the weak ones and the sum over all, which is returned."""
        weak, seen = F.col("_left") < self.k, Observation()
        sums = {"total": F.col("_left"), "rows": F.when(weak, F.col("_left")), "size": F.when(weak, value_bytes(left.select(key)))}
        stored = cut_lineage(left.observe(seen, *[F.coalesce(F.sum(sums[name]), F.lit(0)).alias(name) for name in sums]))
        self.left[key].append(stored)
        self.weak[key] = stored.filter(weak).select(key), seen.get["size"], seen.get["rows"]
        return seen.get["total"]

    def _remove(self, key: str) -> None:
        """The weak keys go, with their rows."""
        if self.weak[key]:
            keys, size, rows = self.weak[key]
            self.gone[key].append((keys, size))
            self.rows -= rows

    def _lose(self, key: str, other: str) -> None:
        """Note what keys have left once the weak ones of the other side are gone."""
        taken, self.weak[other], self.weak[key] = self.weak[other], None, None
        if not taken or not taken[2]:
            return
        keys, size, rows = taken
        removed = self._without_gone(_among(self.edges, keys, other, self.hot[other], size=size), key)
        lost = self._counts(removed, key, "_lost")
        if rows * LOSS_BYTES <= KEYS_LIMIT_BYTES:
            lost = F.broadcast(lost)
        left = union_all(self.left[key]).join(lost, key).groupBy(key)
        # Few rows go after the first rounds; a map task opens a file for each partition of its exchange.
        usual = int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        with conf_scope(self.edges.sparkSession, spark__sql__shuffle__partitions=min(usual, 1 + rows // TASK_ROWS)):
            self._note(key, left.agg((F.min("_left") - F.max("_lost")).alias("_left")))

    def _without(self, df: DataFrame, key: str, gone: list[tuple[DataFrame, int]]) -> DataFrame:
        if not gone:
            return df
        size = sum(size for _, size in gone)
        return _among(df, union_all([keys for keys, _ in gone]), key, self.hot[key], "left_anti", size)

    def _without_gone(self, df: DataFrame, key: str) -> DataFrame:
        return self._without(df, key, self.gone[key][self.applied[key]:])

    def remaining(self) -> DataFrame:
        """The edges between keys that are still there."""
        return self._without_gone(self._without_gone(self.edges, self.user), self.item)

    def go_on_with(self, edges: DataFrame) -> DataFrame:
        """Take a copy of the edges that are left as the edge table; returns the one before."""
        before, self.edges = self.edges, edges
        self.applied = {key: len(gone) for key, gone in self.gone.items()}
        return before

    def among_remaining(self, df: DataFrame) -> DataFrame:
        """Rows of `df`, the table that the edges came from, between keys that are still there."""
        kept = require_keys(df, list(self.hot))
        for key in self.hot:
            kept = self._without(kept, key, self.gone[key])
        return kept.select(*df.columns)

    def survivors(self) -> tuple[DataFrame, DataFrame]:
        users, items = (self._without(self.left[key][0].select(key), key, self.gone[key]) for key in self.hot)
        return users, items


def kcore_report(before: DataFrame, core: KCore, user: str = USER, item: str = ITEM) -> DataFrame:
    """One row: rounds, input and kept rows, users, items and rows per user."""
    input_rows = before.count()
    kept = core.rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(user).alias("users"),
        F.count_distinct(item).alias("items"),
    )
    return kept.select(
        F.lit(len(core.trace)).alias("rounds"),
        F.lit(core.converged).alias("converged"),
        F.lit(input_rows).cast("bigint").alias("input_rows"),
        "rows",
        percent(F.col("rows"), F.lit(input_rows)).alias("kept_pct"),
        "users",
        "items",
        ratio(F.col("rows"), F.col("users")).alias("rows_per_user"),
    )
