"""Recency, frequency and monetary scores and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefeatures import parse_prefix, r2
from ..sources.scratch import stored
from .ranking import exact_ntile


def segment(r: Column, f: Column, m: Column) -> Column:
    """The first rule that holds."""
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((f >= 4) & (m >= 3), "Clients fidèles")
        .when((r >= 4) & (f <= 2), "Nouveaux")
        .when((r <= 2) & (f >= 3), "À risque")
        .when((r <= 2) & (f <= 2), "Perdus")
        .otherwise("Clients fidèles")
    )


def rfm_metrics(transactions: DataFrame) -> DataFrame:
    """Days since the last transaction of all data, number and sum of transactions of each user; a null user is a row."""
    dated = transactions.select("user_id", "amount", parse_prefix(F.col("timestamp")).alias("_ts")).where("_ts is not null")
    # Stored, so that the last time of all is found among users and transactions are read once.
    users = stored(dated.groupBy("user_id").agg(F.max("_ts").alias("_last"), F.count(F.lit(1)).alias("frequency"), r2(F.sum("amount")).alias("monetary")), "rfm-users")
    last = users.agg(F.max("_last").alias("_ref"))
    return users.crossJoin(F.broadcast(last)).select("user_id", F.datediff("_ref", F.to_date("_last")).alias("recency"), "frequency", "monetary")


def rfm(transactions: DataFrame, users: DataFrame) -> DataFrame:
    """Metrics, quintile scores (ties by user), RFM segment and the user's own segment, ordered by user."""
    df = exact_ntile(rfm_metrics(transactions), 5, ["recency", "frequency", "monetary"], "user_id")
    df = df.withColumn("recency_score", F.lit(6) - F.col("recency_score"))
    df = df.withColumn("rfm_segment", segment(F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")))
    return (
        df.join(users.select("user_id", "customer_segment"), "user_id", "left")
        .select("user_id", "recency", "frequency", "monetary", "recency_score", "frequency_score", "monetary_score", "rfm_segment", "customer_segment")
        .orderBy("user_id")
    )


def rfm_crosstab(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rfm_segment", "customer_segment").agg(F.count(F.lit(1)).alias("customer_count")).orderBy("rfm_segment", "customer_segment")


def rfm_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customer_count")).orderBy("rfm_segment")
