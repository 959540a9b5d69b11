"""Merchant KPIs and rankings, and global KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_sum, money_texts
from ..functions.timefeatures import r2

_KEYS = ["merchant_id", "merchant_name", "merchant_category", "region", "commission_rate"]
_GROUPS = {"sales_Jeune": "Jeune", "sales_Adulte": "Adulte", "sales_Age_Moyen": "Âge Moyen", "sales_Senior": "Senior"}
REPORT = [*_KEYS, "total_revenue", "transaction_count", "unique_customers", "average_transaction_amount", "total_commission", *_GROUPS, "rank_in_category", "rank_in_region"]


def by_customer(enriched: DataFrame) -> DataFrame:
    """One row for each merchant and customer, from which the reports below are made without reading transactions again.

    Distinct customers are counted in this second step, so that one wide
    aggregation serves every column and a large merchant is spread. Flagged
    transactions bring their suspicious ones as well. Rows without the
    merchants' columns are added up by merchant id and customer.
    """
    sums = {name: F.sum(F.when(F.col("age_group") == label, F.col("amount")).otherwise(0.0)) for name, label in _GROUPS.items()}
    sums |= {"_exact": exact_sum("amount"), "_sum": F.sum("amount"), "_filled": F.count("amount"), "_n": F.count(F.lit(1))}
    keys = [k for k in _KEYS if k in enriched.columns]
    if "commission_rate" in keys:
        sums["_fee"] = F.sum(F.col("amount") * F.col("commission_rate"))
    if "is_suspicious" in enriched.columns:
        sums["_suspicious"] = F.sum("is_suspicious")
    return enriched.groupBy(*keys, "user_id").agg(*[c.alias(n) for n, c in sums.items()])


def merchant_report(enriched: DataFrame) -> DataFrame:
    """KPIs, sales by age group and ranks of each merchant, best first; transactions without a merchant are left out."""
    return report_by_customer(by_customer(enriched))


def merchant_report_with_suspicion(flagged: DataFrame) -> DataFrame:
    """The merchant report of flagged transactions and each merchant's share of suspicious ones in percent, in one aggregation.

    ``flagged`` are the enriched transactions with ``is_suspicious``, see ``windows.detect_suspicious``.
    """
    return report_by_customer(by_customer(flagged))


def _with_merchants(customers: DataFrame, merchants: DataFrame) -> DataFrame:
    """``by_customer`` rows by merchant id alone, added up, each with every row of its merchant."""
    sums = ["_sum", "_filled", "_n", *_GROUPS, *[c for c in customers.columns if c == "_suspicious"]]
    added = customers.groupBy("merchant_id").agg(*[F.sum(c).alias(c) for c in sums], F.count("user_id").alias("_customers"))
    named = merchants.select("merchant_id", F.col("name").alias("merchant_name"), F.col("category").alias("merchant_category"), "region", "commission_rate")
    return added.join(named, "merchant_id", "left").withColumn("_fee", F.col("_sum") * F.col("commission_rate"))


def report_by_customer(customers: DataFrame, merchants: DataFrame | None = None) -> DataFrame:
    """The merchant report from ``by_customer`` rows, with suspicious rates if these have them.

    Rows by merchant id alone are added up before ``merchants`` are joined, so
    that only sums meet these.
    """
    rated = "_suspicious" in customers.columns
    known = customers.where(F.col("merchant_id").isNotNull())
    rows = known if merchants is None else _with_merchants(known, merchants)
    kpis = rows.groupBy(*_KEYS).agg(
        r2(F.sum("_sum")).alias("total_revenue"),
        F.sum("_n").alias("transaction_count"),
        (F.count("user_id") if merchants is None else F.max("_customers")).alias("unique_customers"),
        r2(F.try_divide(F.sum("_sum"), F.sum("_filled"))).alias("average_transaction_amount"),
        r2(F.sum("_fee")).alias("total_commission"),
        *[F.sum(n).alias(n) for n in _GROUPS],
        *([F.sum("_suspicious").alias("_suspicious")] if rated else []),
    )
    if rated:  # by id alone: a merchant of several names or rates has one share
        of_id = Window.partitionBy("merchant_id")
        kpis = kpis.withColumn("suspicious_transaction_rate", r2(F.sum("_suspicious").over(of_id).cast("double") / F.sum("transaction_count").over(of_id) * 100))
    best = F.col("total_revenue").desc()
    return (
        kpis.withColumn("rank_in_category", F.dense_rank().over(Window.partitionBy("merchant_category").orderBy(best)))
        .withColumn("rank_in_region", F.dense_rank().over(Window.partitionBy("region").orderBy(best)))
        .select(*REPORT, *(["suspicious_transaction_rate"] if rated else []))
        .orderBy(F.desc("total_revenue"), "merchant_id")
    )


def global_kpi_by_customer(customers: DataFrame, formatted: bool = False) -> DataFrame:
    """``global_kpi``, or ``global_kpi_formatted``, from ``by_customer`` rows."""
    revenue, average = r2(F.sum("_sum")), r2(F.try_divide(F.sum("_sum"), F.sum("_filled")))
    if formatted:
        lost = F.count(F.when(F.col("_exact").isNull() & (F.col("_filled") > 0), 1))  # a sum that is not exact
        revenue, average = money_texts(F.when(lost == 0, F.try_sum("_exact")), F.sum("_sum"), F.sum("_filled"))
    return customers.agg(
        revenue.alias("total_revenue"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("transaction_count"),
        F.countDistinct("user_id").alias("unique_customers"),
        average.alias("average_transaction_amount"),
    )


def merchant_revenue_ranking(enriched: DataFrame) -> DataFrame:
    """Revenue, transactions and distinct customers by merchant, best first."""
    return (
        enriched.where(F.col("merchant_id").isNotNull())
        .groupBy("merchant_id")
        .agg(r2(F.sum("amount")).alias("total_revenue"), F.count(F.lit(1)).alias("transaction_count"), F.countDistinct("user_id").alias("unique_customers"))
        .orderBy(F.desc("total_revenue"), "merchant_id")
    )


def kpi_describe(report: DataFrame) -> DataFrame:
    """Count, mean, standard deviation, smallest and largest of the seven KPI columns."""
    return report.describe("total_revenue", "transaction_count", "unique_customers", "average_transaction_amount", "total_commission", "rank_in_category", "rank_in_region")


def global_kpi(enriched: DataFrame) -> DataFrame:
    """Rounded totals over all transactions."""
    return enriched.agg(
        r2(F.sum("amount")).alias("total_revenue"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.countDistinct("user_id").alias("unique_customers"),
        r2(F.avg("amount")).alias("average_transaction_amount"),
    )


def global_kpi_formatted(enriched: DataFrame) -> DataFrame:
    """The same totals with amounts as text such as ``1,234.56``, of sums that are exact: text shows the noise of added doubles."""
    revenue, average = money_texts(exact_sum("amount"), F.sum("amount"), F.count("amount"))
    return enriched.agg(
        revenue.alias("total_revenue"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.countDistinct("user_id").alias("unique_customers"),
        average.alias("average_transaction_amount"),
    )
