"""Product, category and payment revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefeatures import r2


def top_products(enriched: DataFrame, n: int = 10) -> DataFrame:
    """The products of the largest revenue; ties by id."""
    return _top(enriched.where(F.col("product_id").isNotNull()).select("product_id", "product_name", "rating", "stock", F.col("amount").alias("_sum"), F.lit(1).alias("_n")), n)


def top_products_of(transactions: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """``top_products`` from transactions that are not enriched: added up by product first, so that only sums meet the products."""
    sums = transactions.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return _top(sums.join(products.select("product_id", F.col("name").alias("product_name"), "rating", "stock"), "product_id", "left"), n)


def _top(rows: DataFrame, n: int) -> DataFrame:
    """The result from rows of ``_n`` transactions of the amount ``_sum``."""
    rating = F.try_divide(F.sum(F.col("rating") * F.col("_n")), F.sum(F.when(F.col("rating").isNotNull(), F.col("_n"))))
    return (
        rows.groupBy("product_id", "product_name")
        .agg(r2(F.sum("_sum")).alias("total_revenue"), r2(rating).alias("average_rating"), F.min("stock").alias("stock"))
        .orderBy(F.desc("total_revenue"), "product_id", "product_name")
        .limit(n)
    )


def category_region(enriched: DataFrame) -> DataFrame:
    """Revenue by merchant category and region, and its share of the region; a null region has no share."""
    return _shares(enriched.select("merchant_category", "region", F.col("amount").alias("_sum"), F.lit(1).alias("_n")))


def category_region_of(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    """``category_region`` from transactions that are not enriched: added up by merchant first, so that only sums meet the merchants."""
    sums = transactions.groupBy("merchant_id").agg(F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return _shares(sums.join(merchants.select("merchant_id", F.col("category").alias("merchant_category"), "region"), "merchant_id"))


def _shares(rows: DataFrame) -> DataFrame:
    """The result from rows of ``_n`` transactions of the amount ``_sum``."""
    by_both = rows.where(F.col("merchant_category").isNotNull()).groupBy("merchant_category", "region").agg(r2(F.sum("_sum")).alias("total_revenue"), F.sum("_n").cast("long").alias("transaction_count"))
    regions = by_both.groupBy("region").agg(F.sum("total_revenue").alias("_region_total"))
    return (
        by_both.join(regions, "region", "left")
        .withColumn("category_share_percent", r2(F.try_divide("total_revenue", "_region_total") * 100))
        .select("merchant_category", "region", "total_revenue", "transaction_count", "category_share_percent")
        .orderBy("region", F.desc("total_revenue"), "merchant_category")
    )


def payment_period(enriched: DataFrame) -> DataFrame:
    """Revenue and transactions by payment method and time of day."""
    return (
        enriched.groupBy("payment_method", "day_period")
        .agg(r2(F.sum("amount")).alias("total_revenue"), F.count(F.lit(1)).alias("transaction_count"))
        .orderBy("payment_method", "day_period")
    )
