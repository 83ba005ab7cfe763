"""Session set-up, scoped configuration, and lineage cutting through the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Where each table written by cut_lineage lies, as long as its DataFrame is in use.
_stored_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
# Open scopes, innermost last; a stored table belongs to the innermost.
_scopes: list[StoredTables] = []


class StoredTables:
    """The tables that operators store while a `with` block over this object runs; `release` deletes their files.

    Results read these tables when they are computed, so release them once the results are written or collected.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, set()

    def __enter__(self) -> StoredTables:
        _scopes.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self)

    def release(self) -> None:
        while self.paths:
            hadoop_path, file_system = _hadoop(self.spark, self.paths.pop())
            file_system.delete(hadoop_path, True)


def build_session(
    app: str,
    cores: int | None = None,
    memory: str | None = None,
    shuffle_partitions: int | None = None,
    adaptive: bool = True,
) -> SparkSession:
    """Session with the settings every job here expects; `cores` selects local mode, else the submitter's master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", str(adaptive).lower())
        .config("spark.sql.adaptive.skewJoin.enabled", str(adaptive).lower())
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


@contextmanager
def conf_scope(spark: SparkSession, **settings: object) -> Iterator[SparkSession]:
    """Apply runtime settings (dots written as `__`) and restore the previous values on exit."""
    names = {key.replace("__", "."): str(value) for key, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield spark
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, else the session's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    return folder


def default_shared_folder(spark: SparkSession) -> None:
    """For tests and single-machine runs: a temporary folder where a `local` session has none configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))


def scratch_path(spark: SparkSession, name: str = "seqloom") -> str:
    """A new path in the shared folder, for files that go with the enclosing StoredTables or when the driver's JVM exits."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop_path, file_system = _hadoop(spark, path)
    file_system.deleteOnExit(hadoop_path)
    for scope in _scopes[-1:]:
        scope.paths.add(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    The result has no history to recompute when executors are lost, is scanned column by column, and carries its
    true size, so the optimizer broadcasts it only when it is small. The files go with `drop_stored`, with the scope of
    the enclosing StoredTables, or when the driver's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/seqloom-{uuid.uuid4().hex}"
    # Nothing reads this job's shuffles once the table is written.
    with conf_scope(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    hadoop_path, file_system = _hadoop(spark, path)
    file_system.deleteOnExit(hadoop_path)
    stored = spark.read.schema(df.schema).parquet(path)
    _stored_paths[stored] = path
    for scope in _scopes[-1:]:
        scope.paths.add(path)
    return stored


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that `cut_lineage` wrote and nothing reads any more; other DataFrames are left."""
    path = _stored_paths.pop(df, None)
    if path:
        hadoop_path, file_system = _hadoop(df.sparkSession, path)
        file_system.delete(hadoop_path, True)
        for scope in _scopes:
            scope.paths.discard(path)


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
