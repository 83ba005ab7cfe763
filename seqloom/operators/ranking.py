"""Row numbers within groups that stay balanced when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from seqloom.plans.inspect import exchange_count
from seqloom.session import cut_lineage

# The most rows of one group that a single task ranks, whatever the input and the cluster.
HOT_GROUP_ROWS = 1_000_000
# Groups that a task's summary of frequent groups keeps apart. Its counts are short by 3.5 rows in SKETCH_ITEMS at most.
SKETCH_ITEMS = 1 << 16


def _group_hash(group: Sequence[str]) -> Column:
    return F.xxhash64(*group)


def _frequent(group: Sequence[str]) -> Column:
    """Mergeable summary of the most frequent groups, by their hashes; it names every group that is large enough."""
    names = ", ".join(f"`{name}`" for name in group)
    return F.expr(f"approx_top_k(xxhash64({names}), {SKETCH_ITEMS // 7}, {SKETCH_ITEMS})")


def _summarised(rows: int, hot_rows: int) -> bool:
    """Whether a summary of so many rows surely names all groups of more than `hot_rows`: those above twice its error."""
    return 7 * rows < hot_rows * SKETCH_ITEMS


def store_with_hot(
    df: DataFrame, groups: Sequence[Sequence[str]], hot_rows: int = HOT_GROUP_ROWS
) -> tuple[DataFrame, list[DataFrame | None]]:
    """`df`, stored, and for each of the groupings its hot groups as `find_hot` gives them.

    The summaries are made by the tasks that write the table, so a table without hot groups takes no further pass.
    """
    seen = Observation()
    summaries = [_frequent(group).alias(f"g{n}") for n, group in enumerate(groups)]
    stored = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *summaries))
    return stored, [_exact(stored, group, seen.get[f"g{n}"], seen.get["rows"], hot_rows) for n, group in enumerate(groups)]


def hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """What `find_hot` finds, as a table even if there is nothing."""
    found = find_hot(df, group, hot_rows)
    return df.sparkSession.createDataFrame([], "_hot BIGINT") if found is None else found


def find_hot(df: DataFrame, group: Sequence[str], hot_rows: int = HOT_GROUP_ROWS) -> DataFrame | None:
    """Table `_hot`: hashes of the groups with more than `hot_rows` rows; None if there are none.

    A table of `hot_rows` rows or less has none. Else one pass makes a summary map-side, and only groups that it names are
    counted, unless the table has so many rows that the summary could miss one; then all groups are. There are fewer than rows / `hot_rows` hot groups, which is what makes this
    table safe to broadcast: 10^12 rows have at most a million, 8 MB.
    """
    rows = df.count()
    named = df.agg(_frequent(group).alias("g")).first()["g"] if rows > hot_rows else None
    return _exact(df, group, named, rows, hot_rows)


def _exact(df: DataFrame, group: Sequence[str], named: list | None, rows: int, hot_rows: int) -> DataFrame | None:
    if rows <= hot_rows:
        return None
    keyed = df.select(_group_hash(group).alias("_hot"))
    if _summarised(rows, hot_rows):
        # A summary's counts are never too low.
        named = [(row["item"],) for row in named or [] if row["count"] > hot_rows]
        if not named:
            return None
        keyed = keyed.join(F.broadcast(df.sparkSession.createDataFrame(named, "_hot BIGINT")), "_hot", "left_semi")
    found = cut_lineage(keyed.groupBy("_hot").count().filter(F.col("count") > hot_rows).select("_hot"))
    return None if found.isEmpty() else found


def split_hot(df: DataFrame, group: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ordinary groups and those of hot ones, by a broadcast of the bounded table of hot groups."""
    same = _group_hash(group) == F.col("_hot")
    return df.join(F.broadcast(hot), same, "left_anti"), df.join(F.broadcast(hot), same, "left_semi")


def ranked(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    pos: str = "pos",
    size: str | None = None,
    hot_rows: int | None = HOT_GROUP_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group's row count when `size` is named.

    Ordinary groups take one window over one exchange. Hot groups are cut into range slices of near-equal size, ranked
    slice by slice, and shifted by the rows in earlier slices. `order` should be a total order within a group.
    `hot_rows=None` skips the search for hot groups. An input that takes a shuffle to compute is stored first and computed
    once, and the pass that stores it also looks for hot groups.
    """
    if hot_rows is None:
        return rank_whole(df, group, order, pos, size)
    if exchange_count(df):
        df, (hot,) = store_with_hot(df, [group], hot_rows)
    else:
        hot = find_hot(df, group, hot_rows)
    if hot is None:
        return rank_whole(df, group, order, pos, size)
    ordinary, large = split_hot(df, group, hot)
    whole = rank_whole(ordinary, group, order, pos, size)
    return whole.unionByName(rank_sliced(large, group, order, pos, size))


def rank_whole(
    df: DataFrame, group: Sequence[str], order: Sequence[str], pos: str, size: str | None
) -> DataFrame:
    per_group = Window.partitionBy(*group)
    df = df.withColumn(pos, F.row_number().over(per_group.orderBy(*order)).cast("bigint"))
    return df.withColumn(size, F.count(F.lit(1)).over(per_group)) if size else df


def rank_sliced(
    df: DataFrame, group: Sequence[str], order: Sequence[str], pos: str, size: str | None
) -> DataFrame:
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written out, because a slice number read from the running partition could differ between two evaluations.
    sliced = cut_lineage(
        df.repartitionByRange(slices, *group, *order).withColumn("_slice", F.spark_partition_id())
    )
    runs = sliced.groupBy("_slice", *group).agg(F.count(F.lit(1)).alias("_run"))
    per_group = Window.partitionBy(*group)
    # Each slice border splits one group, so there are at most slices + hot groups runs: small enough to broadcast.
    shifts = runs.select(
        F.col("_slice").alias("_s"),
        *[F.col(name).alias(f"_g{i}") for i, name in enumerate(group)],
        (F.sum("_run").over(per_group.orderBy("_slice")) - F.col("_run")).alias("_before"),
        F.sum("_run").over(per_group).alias("_total"),
    )
    in_slice = Window.partitionBy("_slice", *group).orderBy(*order)
    same_run = F.col("_slice") == F.col("_s")
    for i, name in enumerate(group):
        same_run = same_run & F.col(name).eqNullSafe(F.col(f"_g{i}"))
    shifted = sliced.withColumn("_rn", F.row_number().over(in_slice)).join(F.broadcast(shifts), same_run)
    shifted = shifted.withColumn(pos, F.col("_before") + F.col("_rn"))
    if size:
        shifted = shifted.withColumn(size, F.col("_total"))
    return shifted.select(*df.columns, pos, *([size] if size else []))
