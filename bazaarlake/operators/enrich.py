"""Enrichment of transactions with their user, product and merchant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefeatures import age_group, with_time_features
from ..sources.scratch import bucketed, drop
from . import long_users
from .skew import HotKeys, hot_keys, split_join

ENRICHED = [
    "transaction_id", "user_id", "product_id", "merchant_id", "amount", "timestamp", "location", "payment_method", "transaction_category",
    "age", "annual_income", "city", "customer_segment",
    "product_name", "product_category", "price", "rating", "stock",
    "merchant_name", "merchant_category", "region", "commission_rate",
]

KEYS = ["user_id", "product_id", "merchant_id"]
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128_000_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows whose JSON text is at most ``size`` bytes; at most ``rows + 1`` rows are read."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return found.n <= rows and (found.bytes or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a small table (see ``is_small``); a larger one is left to be shuffled."""
    return F.broadcast(df) if is_small(df, rows, size) else df


Dimension = tuple[DataFrame, str]


def _copied(tx: DataFrame, moved: list[Dimension], large: bool) -> tuple[DataFrame, str | None]:
    """The transactions in buckets of the key they are joined by first, where they would be shuffled for several large dimensions."""
    return bucketed(tx, moved[0][1], "transactions") if large else (tx, None)


def _left_joins(tx: DataFrame, copy: str | None, moved: list[Dimension], small: list[Dimension], hot: HotKeys) -> DataFrame:
    """Left joins with the dimensions: those ``moved`` in their order, then the ``small`` ones, broadcast.

    ``copy`` is the folder of the transactions if ``_copied`` wrote them. Then
    rows go from one join to the next by a bucketed table, not by a shuffle,
    and the table before is deleted; only a key with hot values is shuffled.
    """
    for n, (dimension, key) in enumerate(moved):
        if copy and not hot.get(key):
            if n:
                before = copy
                tx, copy = bucketed(tx, key, "joined")
                drop(tx.sparkSession, before)
            dimension = bucketed(dimension, key, "dimension")[0]
        tx = split_join(tx, dimension, key, hot.get(key, {}))
    for dimension, key in small:
        tx = tx.join(F.broadcast(dimension), key, "left")
    return tx


def _narrow(transactions: DataFrame, users: DataFrame, products: DataFrame, merchants: DataFrame, broadcast: bool) -> tuple[DataFrame, str | None, list[Dimension], list[Dimension]]:
    """What ``_left_joins`` needs for the 22 columns; see ``joined``."""
    tx = transactions.withColumnRenamed("category", "transaction_category")
    tx = tx.select(*[c for c in ENRICHED if c in tx.columns])
    users = users.select("user_id", "age", "annual_income", "city", "customer_segment")
    products = products.select("product_id", F.col("name").alias("product_name"), F.col("category").alias("product_category"), "price", "rating", "stock")
    merchants = merchants.select("merchant_id", F.col("name").alias("merchant_name"), F.col("category").alias("merchant_category"), "region", "commission_rate")
    automatic = not tx.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    moved, small, large = [], [], 0
    for dimension, key in ((merchants, "merchant_id"), (products, "product_id"), (users, "user_id")):
        fits = (broadcast or key != "user_id") and is_small(dimension)
        (small if fits and (broadcast or automatic) else moved).append((dimension, key))
        large += not fits
    return *_copied(tx, moved, large > 1), moved, small


def joined(transactions: DataFrame, users: DataFrame, products: DataFrame, merchants: DataFrame, broadcast: bool = False, hot: HotKeys | None = None) -> DataFrame:
    """Left joins with the three dimensions and the 22 columns kept.

    Products and merchants that are small enough (see ``is_small``) are
    broadcast, unless the session has automatic broadcasts switched off, users
    only where ``broadcast`` asks for it. Rows of keys named
    in ``hot`` are dealt among several tasks in the other joins. Of these users
    come last, so that the windows by user that follow need no other shuffle;
    what is broadcast is joined after them, so that no shuffle moves its columns.
    Where products or merchants are large as well as users, the rows go through
    bucketed tables instead of shuffles (see ``_left_joins``).
    """
    return _left_joins(*_narrow(transactions, users, products, merchants, broadcast), hot or {}).select(*ENRICHED)


def enrich(transactions: DataFrame, users: DataFrame, products: DataFrame, merchants: DataFrame, broadcast: bool = False, hot: HotKeys | None = None) -> DataFrame:
    """31 columns: the joined ones, six time features, rank and count per user, and the age group.

    Equal timestamps of a user are ranked by ``transaction_id``. Keys of very
    many rows are joined, and such users ranked, in several tasks each, with
    the same result; ``hot`` names them (see ``skew.hot_keys``) and is found
    here if it is not given.
    """
    tx, *dimensions = _narrow(transactions, users, products, merchants, broadcast)
    hot = hot_keys(tx, KEYS) if hot is None else hot
    user = Window.partitionBy("user_id")

    def usual(df: DataFrame) -> DataFrame:
        return df.withColumns({"transaction_rank": F.row_number().over(user.orderBy("timestamp", "transaction_id")), "transaction_count": F.count(F.lit(1)).over(user)})

    wide = with_time_features(_left_joins(tx, *dimensions, hot).select(*ENRICHED))
    return long_users.split(wide, list(hot.get("user_id", ())), usual, long_users.ranks).withColumn("age_group", age_group(F.col("age")))


def as_often(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Each row of ``df`` as often as a left join with ``dimension`` gives it, and no column of that.

    For reports that need none of its columns. Mostly no key comes twice, and
    then nothing is joined; otherwise only the repeated keys are.
    """
    times = dimension.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    if times.isEmpty():
        return df
    many = df.join(broadcast_if_small(times), key, "left")
    return many.withColumn("_time", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("_times").cast("int"), F.lit(1))))).select(*df.columns)


def timed(transactions: DataFrame, users: DataFrame, products: DataFrame, merchants: DataFrame) -> DataFrame:
    """The rows of ``enrich`` with the transactions' own columns and time features: for reports that need no column of the dimensions."""
    for dimension, key in ((merchants, "merchant_id"), (products, "product_id"), (users, "user_id")):
        transactions = as_often(transactions, dimension, key)
    return with_time_features(transactions)


def aged(transactions: DataFrame, users: DataFrame, products: DataFrame, broadcast: bool = False, hot: HotKeys | None = None) -> DataFrame:
    """``merchant_id``, ``user_id``, ``amount`` and ``age_group``: what reports by merchant and customer need of the enriched rows besides the merchants.

    No other column is moved to join the users; ``broadcast`` and ``hot`` as in ``joined``.
    """
    rows = as_often(transactions.select("product_id", "merchant_id", "user_id", "amount"), products, "product_id").drop("product_id")
    users = users.select("user_id", age_group(F.col("age")).alias("age_group"))
    if broadcast and is_small(users):
        return rows.join(F.broadcast(users), "user_id", "left")
    hot = hot_keys(transactions, ["user_id"]) if hot is None else hot
    return split_join(rows, users, "user_id", hot.get("user_id", {}))


def broadcast_merchant_join(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    """All transaction and merchant columns; the merchant's ``category`` becomes ``merchant_category``. Broadcast if small."""
    return transactions.join(broadcast_if_small(merchants.withColumnRenamed("category", "merchant_category")), "merchant_id", "left")


def enrich_broadcast(transactions: DataFrame, users: DataFrame, products: DataFrame, merchants: DataFrame) -> DataFrame:
    """The wide form: every column of the four tables, each dimension broadcast if it is small enough, and the time features.

    The others are joined first, so that no shuffle moves a broadcast dimension's columns,
    and several of them by bucketed tables (see ``_left_joins``).
    """
    products = products.withColumnsRenamed({"merchant_id": "product_merchant_id", "category": "product_category"})
    merchants = merchants.withColumnsRenamed({"name": "merchant_name", "category": "merchant_category"})
    dimensions = [(df, key, is_small(df)) for df, key in ((users, "user_id"), (products, "product_id"), (merchants, "merchant_id"))]
    moved, small = ([(df, key) for df, key, fits in dimensions if fits == which] for which in (False, True))
    tx, copy = _copied(transactions, moved, len(moved) > 1)
    df = _left_joins(tx, copy, moved, small, hot_keys(tx, [key for _, key in moved]) if copy else {})
    own = [c for c in transactions.columns if c not in KEYS]
    added = [c for dimension, key, _ in dimensions for c in dimension.columns if c != key]
    return with_time_features(df.select("merchant_id", "product_id", "user_id", *own, *added))
