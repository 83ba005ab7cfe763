"""k-core by local peeling: each task removes all it can before anything is exchanged.

The edges are dealt out by user. A part knows its users' rows and, for each of its items, how many rows the item has in all
parts. Whatever the other parts do, an item that has lost so many rows here that fewer than k can be left is gone, and so is a
user with fewer than k rows; their rows go, which may make others go. A part follows this to its end and then reports what its
items have lost. A ledger adds up the losses; the parts that hold an item are told once, when it is out, and the next exchange
begins. The fixpoint is reached when no item is out anew.

Parts are stored once, in the layout of the exchange, and never moved or written again: what they have removed follows from
what they were told. So the rows exchanged are the losses, and the items that go with their holders, not parts times exchanges.

Users with very many partners are dealt out by partner and treated like items, so that parts have about the same size.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.session import conf_scope, cut_lineage, drop_stored, scratch_path
from seqloom.sources.readers import union_all

# Pairs of a user and an item in one part, which a task holds in some 30 bytes each.
PART_PAIRS = 1 << 19


class _Part:
    """Edges of one part. Totals are rows in all parts at the start; of users that only this part holds -1."""

    def __init__(self, users: pa.Array, items: pa.Array, u: np.ndarray, i: np.ndarray, n: np.ndarray, total_u: np.ndarray, total_i: np.ndarray):
        self.users, self.items, self.u, self.i, self.n, self.total_u, self.total_i = users, items, u, i, n, total_u, total_i

    @staticmethod
    def first(rows: pa.Table) -> _Part:
        rows = rows.sort_by("user")
        users, items = (rows.column(name).combine_chunks().dictionary_encode() for name in ("user", "item"))
        u, i = users.indices.to_numpy(), items.indices.to_numpy()
        total_u, total_i = np.empty(len(users.dictionary), np.int64), np.empty(len(items.dictionary), np.int64)
        total_u[u], total_i[i] = (rows.column(name).to_numpy() for name in ("total_u", "total_i"))
        return _Part(users.dictionary, items.dictionary, u, i, rows.column("n").to_numpy(), total_u, total_i)

    def row(self, number: int) -> pa.Table:
        ends = [pa.array([np.ascontiguousarray(a, np.int32).tobytes()]) for a in (self.u, self.i)]
        counts = [pa.array([np.ascontiguousarray(a, np.int64).tobytes()]) for a in (self.n, self.total_u, self.total_i)]
        columns = [pa.array([number], pa.int32()), _one(self.users), _one(self.items), *ends, *counts]
        return pa.table(columns, ["part", "users", "items", "u", "i", "n", "total_u", "total_i"])

    @staticmethod
    def stored(row: pa.Table) -> _Part:
        lists = [row.column(name).combine_chunks().flatten() for name in ("users", "items")]
        ends = [np.frombuffer(row.column(name)[0].as_py(), np.int32).astype(np.int64) for name in ("u", "i")]
        return _Part(*lists, *ends, *[np.frombuffer(row.column(name)[0].as_py(), np.int64) for name in ("n", "total_u", "total_i")])

    def places(self, messages: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Users and items that the messages name."""
        found = []
        for name, keys in (("of_user", self.users), ("of_item", self.items)):
            named = messages.column(name).combine_chunks().drop_null()
            found.append(pc.index_in(named, value_set=keys).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        return tuple(found)

    def peel(self, k: int, told: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Remove what cannot stay after each set of users and items said to be out. Rows that users and items lost before
        the last set, rows that they lost in all, and the edges that are gone."""
        lost = [np.zeros(len(self.users), np.int64), np.zeros(len(self.items), np.int64)]
        ends, before = (self.u, self.i), lost
        held = [np.bincount(e, self.n, len(x)).astype(np.int64) for e, x in zip(ends, lost)]
        totals = [np.where(t < 0, h, t) for t, h in zip((self.total_u, self.total_i), held)]
        order = [np.argsort(e, kind="stable") for e in ends]
        first = [np.concatenate([[0], np.cumsum(np.bincount(e, minlength=len(x)))]) for e, x in zip(ends, lost)]
        gone = np.zeros(len(self.u), bool)
        out = [np.zeros(len(x), bool) for x in lost]
        weak = [np.flatnonzero(t < k) for t in totals]
        for nodes in told:
            before = [x.copy() for x in lost]
            falling = [np.union1d(w, x) for w, x in zip(weak, nodes)]
            falling = [f[~o[f]] for f, o in zip(falling, out)]
            while len(falling[0]) + len(falling[1]):
                edges = []
                for side in (0, 1):
                    out[side][falling[side]] = True
                    starts = first[side][falling[side]]
                    counts = first[side][falling[side] + 1] - starts
                    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    edges.append(order[side][np.repeat(starts, counts) + inside])
                edges = np.unique(np.concatenate(edges))
                edges = edges[~gone[edges]]
                gone[edges] = True
                for side in (0, 1):
                    ends_here = ends[side][edges]
                    np.add.at(lost[side], ends_here, self.n[edges])
                    touched = np.unique(ends_here)
                    falling[side] = touched[(totals[side][touched] - lost[side][touched] < k) & ~out[side][touched]]
        return before, lost, gone


def peeled(edges: DataFrame, k: int, user: str, item: str, hot: DataFrame | None, part_pairs: int = PART_PAIRS):
    """The users and the items of the k-core of `edges`, each once, and the trace (exchange, rows left, seconds).

    Equal edges are counted map-side. `hot` lists the hashes of users to be dealt out by item, see `ranking.find_hot`. A
    message is a row per node that is out and part that holds it; nothing passes through the driver but the number of rows.
    """
    began, spark = time.perf_counter(), edges.sparkSession
    seen = Observation()
    pairs = edges.groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    pairs = counted = cut_lineage(pairs.observe(seen, F.count(F.lit(1)).alias("pairs")))
    parts = max(1, -(-seen.get["pairs"] // part_pairs))
    # Stored, so that the joins know their size and adaptive execution can split the partitions of hot keys.
    totals = cut_lineage(pairs.groupBy("item").agg(F.sum("n").alias("total_i")))
    pairs, shared_totals = pairs.join(totals, "item"), None
    if hot is None:
        pairs = pairs.withColumn("total_u", F.lit(-1).cast("bigint"))
    else:
        shared = counted.join(F.broadcast(hot), F.xxhash64("user") == F.col("_hot"), "left_semi")
        shared_totals = cut_lineage(shared.groupBy("user").agg(F.sum("n").alias("total_u")))
        pairs = pairs.join(shared_totals, "user", "left").fillna(-1, ["total_u"])
    by_pair, by_user = (F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int") for key in (["user", "item"], ["user"]))
    part = F.when(F.col("total_u") >= 0, by_pair).otherwise(by_user)
    dealt = pairs.select(part.alias("part"), "user", "item", "n", "total_u", "total_i")
    types = dict(pairs.dtypes)
    node = f"user {types['user']}, item {types['item']}"
    state_schema = (
        f"part int, users array<{types['user']}>, items array<{types['item']}>, u binary, i binary, n binary, total_u binary, "
        "total_i binary"
    )

    def pack(rows: pa.Table) -> pa.Table:
        return _Part.first(rows).row(rows.column("part")[0].as_py())

    name = _laid_out(dealt.groupBy("part").applyInArrow(pack, state_schema), parts)
    for table in (counted, shared_totals):
        if table is not None:
            drop_stored(table)
    state = spark.table(name)
    told = [spark.createDataFrame([], f"to int, of_{node.replace(', ', ', of_')}, at int")]

    def step(at: int):
        def report(left: pa.Table, right: pa.Table) -> pa.Table:
            own = _Part.stored(left)
            new = pc.equal(right.column("at"), at)
            known = own.places(right.filter(pc.invert(new))), own.places(right.filter(new))
            before, lost, gone = own.peel(k, known)
            number, kinds = left.column("part")[0].as_py(), (own.users.type, own.items.type)
            rows = [pa.table([[number], [int(own.n[~gone].sum())], *[pa.nulls(1, kind) for kind in kinds], *[pa.nulls(1, pa.int64())] * 2],
                             _REPORT)]
            for side, (keys, total) in enumerate(((own.users, own.total_u), (own.items, own.total_i))):
                # The first report names all nodes that others may hold too, so that it says who holds them.
                wanted = total >= 0
                if at:
                    wanted &= lost[side] > before[side]
                    wanted[np.concatenate([known[0][side], known[1][side]])] = False
                    lost[side] = lost[side] - before[side]
                places = np.flatnonzero(wanted)
                nodes = [pa.nulls(len(places), kind) for kind in kinds]
                nodes[side] = keys.take(pa.array(places))
                rows.append(pa.table([[number] * len(places), pa.nulls(len(places), pa.int64()), *nodes, lost[side][places], total[places]],
                                     _REPORT))
            kind = pa.schema([("part", pa.int32()), ("left_rows", pa.int64()), ("user", kinds[0]), ("item", kinds[1]),
                              ("lost", pa.int64()), ("total", pa.int64())])
            return pa.concat_tables([table.cast(kind) for table in rows])

        return report

    schema = f"part int, left_rows long, {node}, lost long, total long"
    ledger = holders = None
    trace: list[tuple[int, int, float]] = []
    while True:
        at = len(trace)
        messages = union_all(told).groupBy("to")
        # With as many partitions as buckets, Spark exchanges the messages and leaves the parts where they are.
        with conf_scope(spark, spark__sql__shuffle__partitions=parts):
            reports, left = _stored(state.groupBy("part").cogroup(messages).applyInArrow(step(at), schema))
        if holders is None:
            holders = reports.filter("lost is not null").select(
                F.col("part").alias("to"), F.col("user").alias("of_user"), F.col("item").alias("of_item")
            )
        trace.append((at + 1, left, time.perf_counter() - began))
        began = time.perf_counter()
        losses = reports.filter("lost > 0").select("user", "item", "lost", "total", F.lit(None).cast("int").alias("out"))
        sums = union_all([losses] if ledger is None else [ledger, losses]).groupBy("user", "item").agg(
            F.sum("lost").alias("lost"), F.max("total").alias("total"), F.min("out").alias("out")
        )
        out = F.coalesce("out", F.when(F.col("total") - F.col("lost") < k, F.lit(at + 1)))
        before, ledger = ledger, cut_lineage(sums.withColumn("out", out))
        for table in (before, reports if at else None):
            if table is not None:
                drop_stored(table)
        dead = cut_lineage(ledger.filter(F.col("out") == at + 1).select("user", "item"))
        if dead.isEmpty():
            break
        same = F.col("user").eqNullSafe(F.col("of_user")) & F.col("item").eqNullSafe(F.col("of_item"))
        told.append(cut_lineage(holders.join(dead, same).select("to", "of_user", "of_item", F.lit(at + 1).alias("at"))))
        drop_stored(dead)

    def staying(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Part.stored(left)
        _, _, gone = own.peel(k, [own.places(right)])
        return pa.table([own.users.take(pa.array(np.unique(own.u[~gone])))], [user])

    found = state.groupBy("part").cogroup(union_all(told).groupBy("to")).applyInArrow(staying, f"`{user}` {types['user']}")
    with conf_scope(spark, spark__sql__shuffle__partitions=parts):
        users = cut_lineage(found if hot is None else found.distinct())
    gone = ledger.filter("item is not null and out is not null").select("item")
    items = cut_lineage(totals.join(gone, "item", "left_anti").select(F.col("item").alias(item)))
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return users, items, trace


_REPORT = ["part", "left_rows", "user", "item", "lost", "total"]


def _laid_out(states: DataFrame, parts: int) -> str:
    """Name of a table that holds the parts in as many buckets, so that an exchange moves the messages alone."""
    spark, name = states.sparkSession, f"seqloom_{uuid.uuid4().hex}"
    with conf_scope(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        states.write.bucketBy(parts, "part").option("path", scratch_path(spark)).saveAsTable(name)
    return name


def _stored(reports: DataFrame) -> tuple[DataFrame, int]:
    """The parts' reports, stored, and the rows left, counted by the same pass."""
    seen = Observation()
    stored = cut_lineage(reports.observe(seen, F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left")))
    return stored, seen.get["left"]


def _one(keys: pa.Array) -> pa.Array:
    """A single list that holds all `keys`."""
    return pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
