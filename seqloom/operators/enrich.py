"""Join interactions with item metadata under a selectable strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.columns import value_bytes
from seqloom.plans.inspect import exchange_count
from seqloom.schemas import ITEM
from seqloom.session import cut_lineage

STRATEGIES = ("auto", "merge", "broadcast", "reduced_broadcast")
# Below the 1 GiB that a driver accepts by default, with room for the hash table each executor builds.
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024
# Bits of the map of used items: 2 MB.
USED_BITS = 1 << 24


def payload_bytes(df: DataFrame) -> int:
    """Measured size of all rows, from the lengths of their values."""
    return df.agg(F.coalesce(F.sum(value_bytes(df)), F.lit(0))).first()[0]


def used_items(items: DataFrame, interactions: DataFrame, item: str = ITEM) -> DataFrame:
    """Items that occur in the interactions. The distinct runs map-side first, so a hot item costs one row per task."""
    return items.join(interactions.select(item).distinct(), item, "left_semi").select(*items.columns)


def reduced_items(items: DataFrame, interactions: DataFrame, item: str = ITEM, bits: int = USED_BITS) -> DataFrame:
    """`used_items`, with most unused items left out before the exact semi-join.

    Map tasks of the interactions set a bit for the hash of each item they see. The OR of these bitmaps has `bits` bits, in rows
    of 4 KB, so it is broadcast whatever the tables hold, and an item whose bit is not set never reaches the exchange. Items
    that share a bit with a used one are left to the semi-join. A task of the interactions sends `bits` bits at most, so this
    pays where items are wide or many; with many more used items than bits nothing is saved, and the result is the same.
    """
    place = F.pmod(F.xxhash64(item), F.lit(bits))
    seen = interactions.filter(F.col(item).isNotNull()).select(place.alias("_place"))
    bitmap = seen.groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )
    at = F.bitmap_bit_position(place)
    placed = items.withColumns({"_at": at.cast("int"), "_own": F.bitmap_bucket_number(place)})
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    # A semi-join, as the optimizer would move the exact one below an inner join.
    held = (F.col("_own") == F.col("_bucket")) & (F.getbit(byte, F.col("_at") % 8) == 1)
    possible = placed.join(F.broadcast(bitmap), held, "left_semi")
    return used_items(possible.select(*items.columns), interactions, item)


def enrich(
    interactions: DataFrame,
    items: DataFrame,
    strategy: str = "auto",
    item: str = ITEM,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Left join with one metadata row per item.

    `merge` shuffles both sides; adaptive execution splits the partition of a hot item. `broadcast` ships the metadata
    when its measured size is within `broadcast_limit`. `reduced_broadcast` first keeps the used items only. `auto`
    tries the metadata as it is, then reduced. Whatever does not fit is merged.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if exchange_count(items):
        # Written once for measuring and joining. It also lets adaptive execution split hot items, which it cannot when
        # the join reads an aggregate.
        items = cut_lineage(items)
    small = strategy in ("auto", "broadcast") and payload_bytes(items) <= broadcast_limit
    if not small and strategy in ("auto", "reduced_broadcast"):
        items = cut_lineage(reduced_items(items, interactions, item))
        small = payload_bytes(items) <= broadcast_limit
    joined = interactions.join(F.broadcast(items) if small else items.hint("merge"), item, "left")
    return joined.select(*interactions.columns, *[name for name in items.columns if name != item])
