"""Scalar expressions on clean interactions and item metadata."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_time(millis: str) -> Column:
    """Epoch milliseconds as a timestamp, without going through floating point."""
    return F.timestamp_millis(F.col(millis))


def digit_length(number: str) -> Column:
    """Number of characters in the decimal form, a minus sign included."""
    return F.length(F.col(number).cast("string"))


def split_label(rev_pos: Column) -> Column:
    """Leave-one-out label: last row `test`, the one before `valid`, everything earlier `train`."""
    return F.when(rev_pos == 1, "test").when(rev_pos == 2, "valid").otherwise("train")


def item_text(
    title: str = "title",
    categories: str = "categories",
    store: str = "store",
    description: str = "description",
) -> Column:
    """Title, categories, store and description joined by ". "; a missing part leaves its separator."""
    blank = F.lit("")
    parts = [
        F.coalesce(F.col(title), blank),
        F.concat_ws(" ", F.col(categories)),
        F.coalesce(F.col(store), blank),
        F.concat_ws(" ", F.col(description)),
    ]
    return F.concat_ws(". ", *parts)


def model_text(text: str, max_chars: int | None = None) -> Column:
    """Encoder input: NULL becomes "", and the text is cut only when the encoder states a character limit."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.substring(whole, 1, max_chars) if max_chars is not None else whole


def price_number(price: str = "price") -> Column:
    """The free-form price as a number where it is one, else NULL."""
    return F.col(price).try_cast("double")


def discount(rank: Column) -> Column:
    """Logarithmic gain of a hit at a 0-based rank."""
    return F.lit(1.0) / F.log2(rank + F.lit(2))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with an empty whole counted as one row."""
    return F.lit(100.0) * part / F.greatest(whole, F.lit(1))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole with an empty whole counted as one row."""
    return part / F.greatest(whole, F.lit(1)).cast("double")


def value_bytes(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """Approximate in-memory width of a row, from the lengths of its variable-size fields."""
    total = F.lit(0)
    for field in df.select(*(columns or df.columns)).schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = F.octet_length(column) + 8
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            width = F.octet_length(F.concat_ws("", column)) + F.size(F.coalesce(column, F.array())) * 8 + 24
        elif isinstance(field.dataType, T.ArrayType):
            width = F.size(F.coalesce(column, F.array())) * 8 + 24
        else:
            width = F.lit(8)
        total = total + F.coalesce(width, F.lit(8)).cast("bigint")
    return total
