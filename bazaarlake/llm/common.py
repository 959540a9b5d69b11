"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored

__all__ = ["fold", "fresh", "give_back", "partitions", "read_table", "sampled", "spread_join", "stored", "trimmed"]

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def spread_join(left: DataFrame, right: DataFrame, on: str | list[str], counts: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Inner join ``on`` a key that is unique in ``right``; no task gets all rows of a key that is common in ``left``.

    ``counts`` (the key and ``n``) tells how often keys occur in ``left``; it is
    counted if not given. Keys of more than a quarter of a partition's fair
    share are hot. There are at most four times as many as partitions, so their
    rows of ``right`` are few; these are repeated once for each share and the
    rows of ``left`` are dealt among the copies by a hash of the columns ``by``
    (all, if not given). ``left`` may be read twice.
    """
    spark, keys = left.sparkSession, [on] if isinstance(on, str) else list(on)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1000, total // (4 * partitions(spark)))
    hot = [(*r[:-1], -(-r[-1] // share)) for r in counts.where(F.col("n") > share).dropna(subset=keys).select(*keys, "n").collect()]
    if not hot:
        return left.join(right, keys)
    kinds = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)
    salts = F.broadcast(spark.createDataFrame(hot, f"{kinds}, _salts int"))
    dealt = left.join(salts, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*(by or left.columns)), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    copied = right.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def give_back() -> None:
    """Return freed memory of this Python worker to the machine: workers live longer than tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` for ``mapInArrow``; what a task has freed does not stay with its worker."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def fold(column: str, modulus: int):
    """crc32 of the decimal id, by which labelled rows are split into learning and held-out parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sampled(df: DataFrame, key: str, limit: int, total: int | None = None) -> DataFrame:
    """About ``limit`` rows, the same ones on every run: those whose hashed key is below a threshold."""
    total = df.count() if total is None else total
    if total <= limit:
        return df
    cut = int(math.ldexp(limit / total, 32))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 32)) < cut)
