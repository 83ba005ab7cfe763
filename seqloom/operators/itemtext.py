"""Item text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqloom.functions.columns import item_text
from seqloom.schemas import ITEM


def text_corpus(items: DataFrame, item: str = ITEM) -> DataFrame:
    """One text per item, built from its metadata."""
    return items.select(item, item_text().alias("text"))
