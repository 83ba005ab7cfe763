"""Tables laid out by a key, so that windows, aggregates and joins by that key need no exchange.

A bucketed table holds the rows of a key in the file of its bucket. A key with very many rows would make one file, and later
one task, as large as it is; such keys lie in a table of their own, in no particular layout, and take the path for hot groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from seqloom.operators.ranking import HOT_GROUP_ROWS, rank_sliced, rank_whole, split_hot, store_with_hot
from seqloom.session import cut_lineage, drop_stored, scratch_path
from seqloom.sources.readers import union_all

BUCKETS = 256


@dataclass
class KeyedTable:
    """Rows of ordinary keys in buckets, and rows of hot keys; `hot` is None if there are none."""

    name: str
    key: str
    buckets: int
    ordinary: DataFrame
    hot: DataFrame | None

    def rows(self) -> DataFrame:
        return self.ordinary if self.hot is None else self.ordinary.unionByName(self.hot)

    def ranked(self, order: Sequence[str], pos: str = "pos", size: str | None = None) -> DataFrame:
        """`ranking.ranked` by the table's key: one window over each bucket; hot keys are ranked in slices."""
        whole = rank_whole(self.ordinary, [self.key], order, pos, size)
        return whole if self.hot is None else whole.unionByName(rank_sliced(self.hot, [self.key], order, pos, size))

    def totals(self, *measures) -> DataFrame:
        """Aggregates by key. Hot keys are pre-aggregated map-side, so only they are exchanged."""
        parts = [df.groupBy(self.key).agg(*measures) for df in (self.ordinary, self.hot) if df is not None]
        return union_all(parts)

    def release(self) -> None:
        """Drop the table and its files."""
        self.ordinary.sparkSession.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        if self.hot is not None:
            drop_stored(self.hot)


def store_by_key(
    df: DataFrame, key: str, buckets: int = BUCKETS, name: str | None = None, hot_rows: int = HOT_GROUP_ROWS
) -> KeyedTable:
    """Write `df` in buckets by `key`, one file each, below the shared folder, and register it in the session's catalog.

    The rows are dealt out by the hash that names the bucket, so a task writes one file. Null keys share a bucket, and are hot
    like any key that has more than `hot_rows` rows. Tables with equal bucket numbers join by their keys without an exchange.
    """
    spark = df.sparkSession
    name = name or f"seqloom_{uuid.uuid4().hex}"
    stored, (hot,) = store_with_hot(df, [[key]], hot_rows)
    ordinary, large = (stored, None) if hot is None else split_hot(stored, [key], hot)
    (
        ordinary.repartition(buckets, key).sortWithinPartitions(key).write.bucketBy(buckets, key).sortBy(key)
        .option("path", scratch_path(spark, "keyed")).mode("overwrite").saveAsTable(name)
    )
    large = None if large is None else cut_lineage(large)
    drop_stored(stored)
    return KeyedTable(name, key, buckets, spark.table(name), large)


def join_by_key(left: KeyedTable, right: DataFrame) -> DataFrame:
    """Rows of a keyed table with the columns of a table that has one row per key and the same layout, such as its totals."""
    def joined(rows: DataFrame) -> DataFrame:
        found = rows.alias("l").join(right.alias("r").hint("merge"), left.key)
        return found.select("l.*", *[f"r.`{name}`" for name in right.columns if name != left.key])

    return union_all([joined(df) for df in (left.ordinary, left.hot) if df is not None])
