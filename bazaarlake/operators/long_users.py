"""Windows of users who hold so many rows that one task should not sort them all.

Rows of such *hot* users (a null user may be one) are cut into chunks of time
between sampled splitters. Windows then run within chunks, and what earlier
chunks of the user bring, counts, sums and the last time, is added to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .skew import LEAST_ROWS, hot_keys, split_join

SPLITS = 200
DAY = 86_400


def hot_users(df: DataFrame, least: int = LEAST_ROWS) -> list[str | None]:
    """Users of more rows than ``least`` and a quarter of a partition's fair share: at most four times as many as partitions."""
    return list(hot_keys(df, ["user_id"], least)["user_id"])


def is_hot(users: list[str | None]) -> Column:
    named = [u for u in users if u is not None]
    hot = F.coalesce(F.col("user_id").isin(named), F.lit(False)) if named else F.lit(False)
    return hot | F.col("user_id").isNull() if None in users else hot


def split(df: DataFrame, users: list[str | None], usual, long) -> DataFrame:
    """``usual`` of most rows and ``long`` of those of hot users, from a stored table; without hot users just ``usual``."""
    if not users:
        return usual(df)
    df = stored(df, "long-users")
    return usual(df.where(~is_hot(users))).unionByName(long(df.where(is_hot(users))))


def _splits(df: DataFrame, place: Column, by: str = "transaction_id") -> DataFrame:
    """``_user, _at``: at most ``SPLITS`` places of each user, sampled by a hash of ``by``."""
    slices = df.groupBy("user_id", F.pmod(F.xxhash64(by), F.lit(SPLITS)).alias("_slice")).agg(F.min_by(place, F.xxhash64(by)).alias("_at"))
    return slices.select(F.col("user_id").alias("_user"), "_at")


def _cut(df: DataFrame, splits: DataFrame, chunks: dict[str, Column]) -> DataFrame:
    """Adds for each of ``chunks`` how many of the user's ``splits`` are not after that place; rows of one place stay together."""
    splits = splits.groupBy("_user").agg(F.array_sort(F.collect_set("_at")).alias("_splits"))
    cut = df.join(F.broadcast(splits), F.col("user_id").eqNullSafe(F.col("_user")), "left")
    return cut.withColumns({name: F.size(F.filter("_splits", _not_after(place))) for name, place in chunks.items()}).drop("_user", "_splits")


def _not_after(place: Column):
    return lambda split: split <= place


def _chunked(df: DataFrame, time: str) -> DataFrame:
    """Adds ``_chunk`` by sampled pairs of time and id, so that many rows of one time are cut too.

    ``df`` is stored, as it is read for the sample and for all that follows.
    """
    df, place = stored(df, "long-users"), F.struct(time, "transaction_id")
    return _cut(df, _splits(df, place), {"_chunk": place})


def _with_earlier(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds for each of ``sums``, by its name, what the user's earlier chunks bring; ``_max`` in a name asks for the largest."""
    chunks = df.groupBy(F.col("user_id").alias("_user"), F.col("_chunk").alias("_of")).agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy("_user").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("_user", "_of", *[(F.max(n) if n.endswith("_max") else F.sum(n)).over(earlier).alias(n) for n in sums])
    return df.join(chunks, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_chunk") == F.col("_of")), "left").drop("_user", "_of")


def ranks(df: DataFrame) -> DataFrame:
    """Adds ``transaction_rank`` and ``transaction_count`` as the windows by user give them."""
    cut = _with_earlier(_chunked(df, "timestamp"), {"_rows": F.count(F.lit(1))})
    counts = df.groupBy(F.col("user_id").alias("_user")).agg(F.count(F.lit(1)).alias("transaction_count"))
    rank = F.row_number().over(Window.partitionBy("user_id", "_chunk").orderBy("timestamp", "transaction_id"))
    ranked = cut.withColumn("transaction_rank", (rank + F.coalesce("_rows", F.lit(0))).cast("int")).drop("_rows", "_chunk")
    return ranked.join(F.broadcast(counts), F.col("user_id").eqNullSafe(F.col("_user"))).drop("_user")


def previous(df: DataFrame) -> DataFrame:
    """Adds ``_before``, the time of the user's previous row."""
    cut = _with_earlier(_chunked(df, "transaction_datetime"), {"_time_max": F.max("transaction_datetime")})
    within = Window.partitionBy("user_id", "_chunk").orderBy("transaction_datetime", "transaction_id")
    before = F.when(F.row_number().over(within) == 1, F.col("_time_max")).otherwise(F.lag("transaction_datetime").over(within))
    return cut.withColumn("_before", before).drop("_time_max", "_chunk")


def frame_sums(moments: DataFrame, seconds: int) -> DataFrame:
    """Adds ``cumulative_amount_7d``, the sum of ``_amount`` over the user's last ``seconds``, to one row for each user and second ``_at``.

    Chunks end at sampled seconds and at each multiple of ``seconds``, so that
    a frame always begins in an earlier chunk than it ends in. It is the end of
    the chunk that it begins in, the whole chunks between, and the beginning of
    its own: three sums of doubles in which nothing is taken away again, so
    that a NaN or a large amount outside of the frame changes nothing. For the
    first of them each row is sent to the chunk where its frame begins.
    """
    grid = moments.select(F.col("user_id").alias("_user"), (F.floor(F.col("_at") / seconds) * seconds).alias("_at")).distinct()
    splits = _splits(moments, F.col("_at"), "_at").unionByName(grid)
    cut = stored(_cut(moments, splits, {"_chunk": F.col("_at"), "_first": F.col("_at") - seconds}), "long-users")

    chunk = Window.partitionBy("user_id", "_chunk")
    own = cut.withColumn("_own", F.sum("_amount").over(chunk.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)))
    asking = own.withColumns({"_home": F.col("_chunk"), "_chunk": F.col("_first"), "_at": F.col("_at") - seconds, "_add": F.lit(None).cast("double"), "_asks": F.lit(True)})
    adding = cut.select("user_id", "_chunk", "_at", F.col("_amount").alias("_add"), F.lit(False).alias("_asks"))
    since = chunk.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    ended = asking.unionByName(adding, allowMissingColumns=True).withColumn("_end", F.sum("_add").over(since)).where("_asks").withColumn("_at", F.col("_at") + seconds)

    sums = cut.groupBy(F.col("user_id").alias("_user"), F.col("_chunk").alias("_of")).agg(F.sum("_amount").alias("_sum")).where("_sum is not null")
    sums = sums.groupBy("_user").agg(F.collect_list(F.struct("_of", "_sum")).alias("_sums"))  # as many as chunks
    spans = cut.select(F.col("user_id").alias("_name"), F.col("_first").alias("_a"), F.col("_chunk").alias("_c")).distinct()
    between = F.filter("_sums", lambda s: (s["_of"] > F.col("_a")) & (s["_of"] < F.col("_c")))
    whole = F.when(F.size("_inside") > 0, F.aggregate("_inside", F.lit(0.0), lambda total, s: total + s["_sum"]))
    spans = spans.join(sums, F.col("_name").eqNullSafe(F.col("_user"))).withColumn("_inside", between).select("_name", "_a", "_c", whole.alias("_whole"))
    summed = ended.join(spans, F.col("user_id").eqNullSafe(F.col("_name")) & (F.col("_first") == F.col("_a")) & (F.col("_home") == F.col("_c")), "left")
    parts = [F.col(c) for c in ("_end", "_whole", "_own")]
    total = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
    return summed.select(*moments.columns, total.alias("cumulative_amount_7d"))


def active_days(moments: DataFrame, seconds: int) -> DataFrame:
    """Adds ``active_days_7d`` to one row for each user and second ``_at``, from one row for each user and day.

    The days after the frame's first day lie wholly in it; that first day
    counts if the user's last second of it does.
    """
    span, day = seconds // DAY, F.unix_date(F.to_date(F.timestamp_seconds("_at")))
    days = moments.groupBy("user_id", day.alias("_day")).agg(F.max("_at").alias("_last"))
    user = Window.partitionBy("user_id").orderBy("_day")
    days = days.select(
        F.col("user_id").alias("_user"),
        F.col("_day").alias("_of"),
        F.count(F.lit(1)).over(user.rangeBetween(-(span - 1), 0)).alias("_inside"),
        F.max("_last").over(user.rangeBetween(-span, -span)).alias("_edge"),
    )
    edge = F.when(F.col("_edge") >= F.col("_at") - seconds, 1).otherwise(0)
    joined = moments.join(days, F.col("user_id").eqNullSafe(F.col("_user")) & (day == F.col("_of")), "left")
    return joined.select(*moments.columns, (F.col("_inside") + edge).cast("int").alias("active_days_7d"))


def seven_days(df: DataFrame, seconds: int) -> DataFrame:
    """Adds ``cumulative_amount_7d``, ``active_days_7d`` and ``_before`` as the windows by user give them.

    Sums and days are the same for all rows of a user and second, so they are
    made from one row for each, and joined back; a second of very many rows is
    dealt among tasks. Rows without a time have the sum of all of the user's
    rows without one, as a range frame, and no active days.
    """
    at = F.unix_timestamp("transaction_datetime")
    rows = stored(previous(df).withColumn("_second", F.struct("user_id", at.alias("at"))), "long-users")
    moments = rows.groupBy("_second").agg(F.sum("amount").alias("_amount")).select(F.col("_second.user_id").alias("user_id"), F.col("_second.at").alias("_at"), "_amount")
    timed = stored(moments.where("_at is not null"), "long-users")
    found = active_days(frame_sums(timed, seconds), seconds).unionByName(moments.where("_at is null").select("user_id", "_at", "_amount", F.col("_amount").alias("cumulative_amount_7d"), F.lit(0).alias("active_days_7d")))
    found = found.select(F.struct("user_id", F.col("_at").alias("at")).alias("_second"), "cumulative_amount_7d", "active_days_7d")
    return split_join(rows, found, "_second", hot_keys(rows, ["_second"])["_second"]).drop("_second")


def earlier_average(df: DataFrame) -> DataFrame:
    """Adds ``historical_average_amount``: the average of the user's earlier amounts."""
    cut = _with_earlier(_chunked(df, "transaction_datetime"), {"_sum": F.sum("amount"), "_held": F.count("amount")})
    before = Window.partitionBy("user_id", "_chunk").orderBy("transaction_datetime", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("amount").over(before), F.lit(0.0)) + F.coalesce("_sum", F.lit(0.0))
    held = F.count("amount").over(before) + F.coalesce("_held", F.lit(0))
    return cut.withColumn("historical_average_amount", F.when(held > 0, total / held)).drop("_sum", "_held", "_chunk")
