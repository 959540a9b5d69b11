"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Buckets of a table that is joined by a key: its files are this many times as many as the tasks that write it.
BUCKETS = 96
#: Its keys and amounts hardly repeat, so that dictionaries only cost time (and, compressed with zstd, some space).
PLAIN = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}

_folders: dict[str, str] = {}
_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("_made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, deleted when the application ends.

    Where the setting is absent a temporary folder of this machine serves, on a
    local master only; on a cluster that raises an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='spark-bazaarlake-')).rstrip('/')}/{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[app] = folder
    return _folders[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that is run inside go as soon as it has ended; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, leaves no shuffle files."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    with without_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, tag: str) -> tuple[DataFrame, str]:
    """``stored`` in buckets of ``key``, so that joins and windows by it shuffle nothing, and the table's folder.

    Takes the place of a shuffle of wide rows: zstd on columns needs about half
    the disk of shuffled rows, and the table before can be deleted.
    """
    spark, path, name = df.sparkSession, scratch_path(df.sparkSession, tag), f"{tag}_{uuid.uuid4().hex}"
    with without_shuffles(spark):
        df.write.format("parquet").options(path=path, **PLAIN).bucketBy(BUCKETS, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # a table with a path: only its name goes, its files stay
    if (made := _made.get()) is not None:
        made.append((spark, path))
    return table, path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that ``bucketed`` has written and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def dropped_after() -> Iterator[None]:
    """What ``bucketed`` writes inside is deleted at the end: for callers that have written what they made of it by then."""
    made: list[tuple[SparkSession, str]] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for spark, path in made:
            drop(spark, path)
