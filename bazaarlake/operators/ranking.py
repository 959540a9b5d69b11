"""Exact global ntile without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

SPLITS = 200


def exact_ntile(df: DataFrame, n: int, metrics: list[str], tiebreak: str) -> DataFrame:
    """Adds ``<metric>_score`` for each metric: the tile (1 to n) by metric, then ``tiebreak``, as ``ntile(n)`` over the whole table gives it.

    The metrics are stacked, and each goes to buckets between at most
    ``SPLITS`` sampled pairs of metric and tiebreak, so heavy ties are split
    too. One window by metric and bucket ranks all of them; the sizes of the
    buckets before are added, which is exact whatever the sample. Nulls come
    first; an empty table gives an empty result. ``tiebreak`` should be unique
    for a result that never changes; metrics are of one type or of types that
    Spark widens. ``df`` is stored, as it is read for the sample, the sizes
    and the ranks.
    """
    columns = df.columns
    df = stored(df.withColumn("_row", F.monotonically_increasing_id()), "ranked")
    places = F.array(*[F.struct(F.col(m).alias("m"), F.col(tiebreak).alias("t")) for m in metrics])
    # Of each slice of the hash space, one pair: at most SPLITS rows for each metric, sorted into one array.
    slices = df.select(F.pmod(F.hash(tiebreak), F.lit(SPLITS)).alias("_slice"), F.xxhash64(tiebreak).alias("_hash"), F.posexplode(places).alias("_metric", "_at"))
    slices = slices.groupBy("_metric", "_slice").agg(F.min_by("_at", "_hash").alias("_at"))
    splits = slices.groupBy("_metric").agg(F.array_sort(F.collect_list("_at")).alias("_splits"))
    rest = F.struct(*columns)
    stacked = df.select("_row", F.posexplode(F.arrays_zip(places.alias("at"), F.array(rest, *[F.lit(None)] * (len(metrics) - 1)).alias("rest"))).alias("_metric", "_both"))
    stacked = stacked.select("_row", "_metric", F.col("_both.at").alias("_at"), F.col("_both.rest").alias("_rest")).join(F.broadcast(splits), "_metric")
    stacked = stacked.withColumn("_bucket", F.size(F.filter("_splits", lambda split: split <= F.col("_at")))).drop("_splits")

    # At most SPLITS + 1 sizes for each metric.
    sizes = stacked.groupBy("_metric", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    metric = Window.partitionBy("_metric")
    before = metric.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_metric", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(metric).alias("_total"))
    rank = F.row_number().over(Window.partitionBy("_metric", "_bucket").orderBy("_at"))
    tiles = stacked.withColumn("_rank", rank).join(F.broadcast(starts), ["_metric", "_bucket"]).withColumn("_tile", _tile(F.col("_rank") + F.col("_before"), F.col("_total"), n))
    scores = [F.max(F.when(F.col("_metric") == i, F.col("_tile"))).alias(f"{m}_score") for i, m in enumerate(metrics)]
    ranked = tiles.groupBy("_row").agg(F.first("_rest", ignorenulls=True).alias("_rest"), *scores)
    return ranked.select(*[F.col("_rest")[c].alias(c) for c in columns], *[f"{m}_score" for m in metrics])


def _tile(rank: Column, total: Column, n: int) -> Column:
    """The tile of a 1-based rank: the first ``total % n`` tiles hold one row more."""
    q, r = F.floor(total / n), total % n
    large = r * (q + 1)
    first = F.floor((rank - 1) / (q + 1)) + 1
    later = r + F.floor(F.try_divide(rank - 1 - large, q)) + 1
    return F.when(rank <= large, first).otherwise(later).cast("int")
