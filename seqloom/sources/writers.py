"""Sinks. Every writer runs on the executors; nothing is funnelled through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None, files: int | None = None) -> None:
    """Overwrite `path`. `partition_by` makes one directory per value; `files` bounds the file count, or with both the number
    of tasks, over which the rows of all values are spread evenly."""
    if files and partition_by:
        gathered = df.repartition(files)
    else:
        gathered = df.coalesce(files) if files else _gathered(df, partition_by)
    writer = gathered.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, partition_by: str | None = None, compression: str | None = None) -> None:
    """Overwrite `path` with one JSON object per line. `compression` names a codec, such as gzip; readers tell it by the files'
    names, and each compressed file is read by one task."""
    writer = _gathered(df, partition_by).write.mode("overwrite")
    if compression:
        # Gzip's fastest level: the default takes three times as long for token examples and saves a third of what is left.
        writer = writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def _gathered(df: DataFrame, partition_by: str | None) -> DataFrame:
    """Rows of a value in few tasks, so that a directory gets files of a useful size; adaptive execution splits large ones."""
    return df.hint("rebalance", partition_by) if partition_by else df


def discard(df: DataFrame) -> None:
    """Compute every column of every row and keep none of them."""
    df.write.format("noop").mode("overwrite").save()
