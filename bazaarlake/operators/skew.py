"""Left joins of a table in which some keys, null among them, have very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import without_shuffles

LEAST_ROWS = 1_000_000
BUCKETS = 4096

HotKeys = dict[str, dict[str | None, int]]


def hot_keys(df: DataFrame, keys: list[str], least: int = LEAST_ROWS) -> HotKeys:
    """For each column of ``keys`` its values, as text, of more rows than ``least`` and a quarter of a partition's fair share, and how many tasks should hold them.

    One scan counts all rows by a hash of each key: ``BUCKETS`` numbers a
    column, whatever its number of keys. A key has at most as many rows as its
    bucket, so that only the keys of large buckets, if there are any, are
    counted themselves, in a second scan. At most four times as many values as
    partitions are hot in a column, so few reach the driver.
    """
    most = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found: HotKeys = {k: {} for k in keys}
    text = {k: f"cast(`{k}` as string)" for k in keys}
    bucket = {k: f"cast(pmod(xxhash64({text[k]}), {BUCKETS}) as int)" for k in keys}
    stacked = lambda of, name: F.expr(f"stack({len(keys)}, {', '.join(f'{n}, {of[k]}' for n, k in enumerate(keys))}) as (_of, {name})")
    with without_shuffles(df.sparkSession):
        counts = df.select(stacked(bucket, "_bucket")).groupBy("_of", "_bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    share = max(least, sum(r.n for r in counts if r["_of"] == 0) // most)
    large = {k: [r["_bucket"] for r in counts if r["_of"] == n and r.n > share] for n, k in enumerate(keys)}
    with without_shuffles(df.sparkSession):
        for k in [k for k in keys if large[k]]:
            rows = df.select(F.expr(text[k]).alias("_key")).where(F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int").isin(large[k]))
            for row in rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).collect():
                found[k][row["_key"]] = -(-row.n // share)
    return found


def _salts(key: str, hot: dict[str | None, int]) -> Column:
    """How many tasks share the rows of a key."""
    text = F.col(key).cast("string")
    named = [x for k, n in hot.items() if k is not None for x in (F.lit(k), F.lit(n))]
    many = F.coalesce(F.try_element_at(F.create_map(*named), text), F.lit(1)) if named else F.lit(1)
    return F.when(text.isNull(), F.lit(hot.get(None, 1))).otherwise(many)


def split_join(left: DataFrame, right: DataFrame, key: str, hot: dict[str | None, int], how: str = "left") -> DataFrame:
    """``left`` or ``left_anti`` join; rows of the ``hot`` keys of ``left`` are dealt among several tasks.

    A null key has no match, so its rows are only dealt. Rows of ``right`` of
    other hot keys are repeated once for each task.
    """
    if not hot:
        return left.join(right, key, how)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), _salts(key, hot)).cast("int"))
    copied = right.where(F.col(key).isNotNull()).withColumn("_salt", F.explode(F.sequence(F.lit(0), _salts(key, hot) - 1)))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
