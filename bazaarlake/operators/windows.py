"""Seven-day windows per user and suspicion flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS, Limits
from ..functions.timefeatures import parse_prefix
from . import long_users

_DAY = long_users.DAY


def _windows(df: DataFrame, limits: Limits) -> DataFrame:
    """Seven-day sum and active days, and the previous time: windows by user alone, so that one shuffle serves all.

    A date counts once, at the first of the user's rows on it. The days before
    the frame's first day lie wholly in the frame; that first day counts if
    the user's last second of it does. A null time counts 0 days; null users
    are one user.
    """
    user, span = Window.partitionBy("user_id"), limits.window_seconds // _DAY
    timed = user.orderBy("_span", "_at", "transaction_id")  # in the order of time; one sort serves the sums in a span too
    by_day = user.orderBy("_day")
    at = F.unix_timestamp("transaction_datetime")
    df = df.withColumns({"_at": at, "_span": F.floor(at / limits.window_seconds), "_day": F.unix_date("transaction_date")})
    new_day = F.when(F.col("_day") != F.coalesce(F.lag("_day", 1).over(timed), F.lit(-1 << 31)), 1)
    df = _frame_sums(df.withColumns({"_before": F.lag("transaction_datetime", 1).over(timed), "_new_day": new_day}), limits.window_seconds)
    inside = F.sum("_new_day").over(by_day.rangeBetween(-(span - 1), 0))
    edge = F.max("_at").over(by_day.rangeBetween(-span, -span)) >= F.col("_at") - limits.window_seconds
    days = F.when(F.col("_day").isNull(), 0).otherwise(inside + F.when(edge, 1).otherwise(0))
    return df.withColumn("active_days_7d", days.cast("int")).drop("_at", "_span", "_day", "_new_day")


def _frame_sums(df: DataFrame, seconds: int) -> DataFrame:
    """Adds ``cumulative_amount_7d``, the sum over the user's last ``seconds``, in time linear in the rows of a user.

    A sliding frame would be summed anew for each row. Here time is cut at the
    multiples of ``seconds``, so that a frame is the beginning of its own span
    up to the row and the end of the span before. Both are running sums, the
    second one backwards, for which each row also asks at the time where its
    frame begins; nothing is subtracted. Rows without a time have the sum of
    all of the user's rows without one, as a range frame.
    """
    forwards = Window.partitionBy("user_id", "_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_own", F.sum("amount").over(forwards))
    asks, rest = F.col("_asks"), [c for c in df.columns if c != "user_id"]
    both = df.withColumn("_asks", F.explode(F.array(F.lit(True), F.lit(False))))
    both = both.select(  # a row that adds is its time and amount alone; ``user_id`` is kept as it is: by it rows are dealt
        "user_id",
        "_asks",
        F.when(asks, F.col("_span") - 1).otherwise(F.col("_span")).alias("_chunk"),
        F.when(asks, F.col("_at") - seconds).otherwise(F.col("_at")).alias("_since"),
        F.when(~asks, F.col("amount")).alias("_add"),
        *[F.when(asks, F.col(c)).alias(c) for c in rest],
    )
    backwards = Window.partitionBy("user_id", "_chunk").orderBy(F.desc("_since")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_end", F.when(F.col("_since").isNotNull(), F.sum("_add").over(backwards))).where("_asks")
    total = F.when(F.coalesce("_end", "_own").isNotNull(), F.coalesce("_end", F.lit(0.0)) + F.coalesce("_own", F.lit(0.0)))
    return both.withColumn("cumulative_amount_7d", total).select(*[c for c in df.columns if c != "_own"], "cumulative_amount_7d")


def window_analysis(enriched: DataFrame, limits: Limits = LIMITS, hot_users: list[str | None] | None = None) -> DataFrame:
    """Adds parsed time and date, seven-day amount and active days, activity flag and days since the last transaction.

    Users named in ``hot_users`` are windowed in several tasks each; they are
    found here if not given.
    """
    hot_users = long_users.hot_users(enriched) if hot_users is None else hot_users
    ts = parse_prefix(F.col("timestamp"))
    df = enriched.withColumn("transaction_datetime", ts).withColumn("transaction_date", F.to_date("transaction_datetime"))
    df = long_users.split(df, hot_users, lambda rows: _windows(rows, limits), lambda rows: long_users.seven_days(rows, limits.window_seconds))
    return df.withColumns(
        {
            "active_user_7d": F.when(F.col("active_days_7d") >= limits.active_days, 1).otherwise(0),
            "days_since_previous_transaction": (F.unix_timestamp("transaction_datetime") - F.unix_timestamp("_before")) / F.lit(86400.0),
        }
    ).drop("_before")


def detect_suspicious(windowed: DataFrame, limits: Limits = LIMITS, hot_users: list[str | None] | None = None) -> DataFrame:
    """Adds the average of earlier amounts, four flags, their sum and the verdict (two flags or more); ``hot_users`` as in ``window_analysis``."""
    hot_users = long_users.hot_users(windowed) if hot_users is None else hot_users
    earlier = Window.partitionBy("user_id").orderBy("transaction_datetime", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    flag = lambda c: F.when(c, 1).otherwise(0)
    averaged = long_users.split(windowed, hot_users, lambda rows: rows.withColumn("historical_average_amount", F.avg("amount").over(earlier)), long_users.earlier_average)
    df = averaged.withColumns(
        {
            "amount_above_300_percent": flag(F.col("historical_average_amount").isNotNull() & (F.col("amount") > limits.outlier_factor * F.col("historical_average_amount"))),
            "night_transaction": flag(F.col("day_period") == "Night"),
            "previous_transaction_less_than_5min": flag(F.col("days_since_previous_transaction").isNotNull() & (F.col("days_since_previous_transaction") < limits.burst_seconds / _DAY)),
            "crypto_payment": flag(F.upper("payment_method") == "CRYPTO"),
        }
    )
    score = F.col("amount_above_300_percent") + F.col("night_transaction") + F.col("previous_transaction_less_than_5min") + F.col("crypto_payment")
    return df.withColumn("suspicion_score", score).withColumn("is_suspicious", flag(F.col("suspicion_score") >= limits.suspicion_score))


def top_suspicious(suspicious: DataFrame, n: int = 20) -> DataFrame:
    """The suspicious transactions of the largest amounts; ties by id."""
    columns = ["transaction_id", "user_id", "amount", "historical_average_amount", "amount_above_300_percent", "night_transaction", "previous_transaction_less_than_5min", "crypto_payment", "suspicion_score"]
    return suspicious.where("is_suspicious = 1").select(*columns).orderBy(F.desc("amount"), "transaction_id").limit(n)
