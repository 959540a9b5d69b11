"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the texts (`repartitionByRange`) by their
first characters and, among equal ones, by hash; each task
sorts its range externally, equal texts become neighbours, and a window over
the sorted texts compares neighbours in full and keeps one id of each run.

A text with very many copies would fill one range, so copies of such *hot*
texts get a salt as a second sort key and spread over several ranges; the few
run leaders of hot texts are then compared with each other once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Column | None = None,
    keep: str = "max",
    num_ranges: int | None = None,
) -> DataFrame:
    """Group documents whose normalised text is identical.

    Returns one row per input row: ``id_col, keep_id, group_size, kept,
    text_sha256``. A null text counts as the empty text; empty texts form one
    group. ``keep`` is ``max`` or ``min``: which id of a group stays. A null id
    sorts below all others and is never kept while the group has another id.
    Rows that repeat both id and text are all returned; each counts in
    ``group_size``, and ``kept`` is true on each row whose id is ``keep_id``.
    An empty table gives an empty result. Other columns are ignored, so their
    names cannot clash.

    Texts cross the network once. Hot texts are those with more copies than a
    quarter of a range's fair share, so there are at most ``4 * num_ranges``.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    spark = docs.sparkSession
    ranges = num_ranges or partitions(spark)
    text = F.coalesce(normalise if normalise is not None else F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_hash", F.xxhash64("_text"))

    counts = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    share = max(64, total // (4 * ranges))
    hot = counts.where(F.col("_n") > share).select("_hash", F.ceil(F.col("_n") / share).cast("int").alias("_salts"))

    spread = rows.join(F.broadcast(hot), "_hash", "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int"), F.lit(0))
    )
    best = F.max if keep == "max" else F.min
    # Splitters are sampled on a short prefix and the hash, so what the driver gathers for them does not grow with text length.
    spread = spread.withColumn("_head", F.substring("_text", 1, 32))
    run = Window.partitionBy("_head", "_hash", "_salt", "_text")
    digests = (
        spread.repartitionByRange(ranges, "_head", "_hash", "_salt")
        .withColumn("_lead", best("_id").over(run))
        .withColumn("_run", F.count(F.lit(1)).over(run))
        .select("_id", "_lead", "_run", "_salt", F.col("_salts").isNotNull().alias("_hot"), "_hash", F.sha2("_text", 256).alias("text_sha256"),
                F.when(F.col("_salts").isNotNull() & (F.row_number().over(run.orderBy("_id")) == 1), F.col("_text")).alias("_text"))
    )
    digests = stored(digests, "exact-runs")

    # One row for each (hot text, salt): compare these in full again.
    leaders = digests.where(F.col("_text").isNotNull())
    merged = leaders.groupBy("_text").agg(
        best("_lead").alias("_keep"), F.sum("_run").alias("_size"), F.collect_set(F.struct("_hash", "_salt", "_lead")).alias("_runs")
    )
    runs = merged.select(F.explode("_runs").alias("_r"), "_keep", "_size").select("_r._hash", "_r._salt", "_r._lead", "_keep", "_size")
    cold = digests.where(~F.col("_hot")).select("_id", F.col("_lead").alias("_keep"), F.col("_run").alias("_size"), "text_sha256")
    warm = (
        digests.where("_hot")
        .alias("d")
        .join(F.broadcast(runs).alias("r"), (F.col("d._hash") == F.col("r._hash")) & (F.col("d._salt") == F.col("r._salt")) & F.col("d._lead").eqNullSafe(F.col("r._lead")))
        .select("d._id", "r._keep", "r._size", "d.text_sha256")
    )
    return cold.unionByName(warm).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        "text_sha256",
    )
