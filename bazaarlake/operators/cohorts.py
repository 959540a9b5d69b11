"""Monthly cohorts by first purchase, their retention and revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefeatures import parse_prefix, r2


def cohort_analysis(transactions: DataFrame) -> DataFrame:
    """Active users, retention and revenue of each cohort in each month since its first.

    Transactions are first reduced to one row for each user and month; the
    cohort month is then the user's smallest one, a window on the same key.
    """
    ts = parse_prefix(F.col("timestamp"))
    monthly = (
        transactions.select("user_id", F.to_date(F.trunc(ts, "month")).alias("transaction_month"), "amount")
        .where(F.col("transaction_month").isNotNull() & F.col("user_id").isNotNull())
        .groupBy("user_id", "transaction_month")
        .agg(F.sum("amount").alias("_amount"))
        .withColumn("cohort_month", F.min("transaction_month").over(Window.partitionBy("user_id")))
        .withColumn("period_index", F.months_between("transaction_month", "cohort_month").cast("int"))
    )
    activity = monthly.groupBy("cohort_month", "period_index").agg(F.count(F.lit(1)).alias("active_users"), r2(F.sum("_amount")).alias("revenue"))
    # Every user is active in the first month, so its count is the size of the cohort.
    sizes = activity.where("period_index = 0").select("cohort_month", F.col("active_users").alias("cohort_size"))
    return (
        activity.join(sizes, "cohort_month", "left")
        .withColumn("retention_rate", r2(F.col("active_users") / F.col("cohort_size") * 100))
        .withColumn("revenue_per_user", r2(F.col("revenue") / F.col("active_users")))
        .select("cohort_month", "period_index", "cohort_size", "active_users", "retention_rate", "revenue", "revenue_per_user")
        .orderBy("cohort_month", "period_index")
    )


def best_cohort_at(cohorts: DataFrame, period: int = 3) -> DataFrame:
    """The cohort of the best retention in a period; ties by the earlier month."""
    return cohorts.where(F.col("period_index") == period).orderBy(F.desc("retention_rate"), "cohort_month").limit(1)
