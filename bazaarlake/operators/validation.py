"""Row validation with a rejection reason, and the data quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS, Limits
from .skew import HotKeys, hot_keys, split_join

Rule = tuple[Column, str]


def tag_and_split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): the first rule that a row breaks is its ``rejection_reason``."""
    reason = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        reason = F.when(broken, text).otherwise(reason)
    tagged = df.withColumn("rejection_reason", reason)
    return tagged.where(F.col("rejection_reason").isNull()).drop("rejection_reason"), tagged.where(F.col("rejection_reason").isNotNull())


def _missing_or(column: str, bad: Column) -> Column:
    return F.col(column).isNull() | bad


def transaction_rules() -> list[Rule]:
    return [
        (_missing_or("amount", F.col("amount") <= 0), "amount invalide (<= 0 ou nul)"),
        (_missing_or("timestamp", F.length("timestamp") != 14), "timestamp mal formé (doit faire 14 caractères)"),
    ]


def user_rules(limits: Limits = LIMITS) -> list[Rule]:
    age = F.col("age")
    return [
        (_missing_or("age", (age < limits.min_age) | (age > limits.max_age)), "age hors intervalle autorisé"),
        (_missing_or("annual_income", F.col("annual_income") <= 0), "annual_income invalide (<= 0 ou nul)"),
    ]


def product_rules(limits: Limits = LIMITS) -> list[Rule]:
    rating = F.col("rating")
    return [
        (_missing_or("price", F.col("price") <= 0), "price invalide (<= 0 ou nul)"),
        (_missing_or("rating", (rating < limits.min_rating) | (rating > limits.max_rating)), "rating hors intervalle autorisé"),
    ]


def merchant_rules() -> list[Rule]:
    rate = F.col("commission_rate")
    return [(_missing_or("commission_rate", (rate < 0) | (rate > 1)), "commission_rate hors intervalle [0, 1]")]


def validate_transactions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tag_and_split(df, transaction_rules())


def validate_users(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tag_and_split(df, user_rules())


def validate_products(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tag_and_split(df, product_rules())


def validate_merchants(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tag_and_split(df, merchant_rules())


def _nulls(columns: list[str]) -> Column:
    per_row = sum((F.col(f"`{c}`").isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    return F.coalesce(F.sum(per_row), F.lit(0).cast("long"))


def count_nulls(df: DataFrame) -> DataFrame:
    """One row ``nb_nulls``: nulls over all columns; 0 for an empty table. NaN is not null, an array counts once."""
    return df.agg(_nulls(df.columns).alias("nb_nulls"))


def reunited(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    """All rows read: valid and rejected ones by column name."""
    return valid.unionByName(rejected.drop("rejection_reason"))


def orphans(transactions: DataFrame, dimension: DataFrame, key: str, hot: HotKeys | None = None) -> DataFrame:
    """Transactions whose key is null or stands in no row of the dimension; keys of very many rows are dealt among tasks."""
    hot = hot_keys(transactions, [key]) if hot is None else hot
    return split_join(transactions, dimension.select(key), key, hot.get(key, {}), "left_anti")


_ORPHANS = {"user_id": "nb_refs_user_id_inexistant", "product_id": "nb_refs_product_id_inexistant", "merchant_id": "nb_refs_merchant_id_inexistant"}


def referential_integrity(transactions: DataFrame, users: DataFrame, products: DataFrame, merchants: DataFrame) -> DataFrame:
    """One row with the three orphan counts, from histograms of the keys.

    One scan of the transactions counts the rows of each key, null ones too;
    only these counts are shuffled, and joined to the keys of the dimensions.
    """
    each = ", ".join(f"'{key}', cast({key} as string)" for key in _ORPHANS)
    rows = transactions.select(F.expr(f"stack({len(_ORPHANS)}, {each}) as (_of, _key)")).groupBy("_of", "_key").agg(F.count(F.lit(1)).alias("_rows"))
    known = None
    for dimension, key in zip((users, products, merchants), _ORPHANS):
        keys = dimension.where(F.col(key).isNotNull()).select(F.lit(key).alias("_of"), F.col(key).cast("string").alias("_key"))
        known = keys if known is None else known.unionByName(keys)
    missing = rows.join(known, ["_of", "_key"], "left_anti")
    return missing.agg(*[F.coalesce(F.sum(F.when(F.col("_of") == key, F.col("_rows"))), F.lit(0)).alias(name) for key, name in _ORPHANS.items()])


def _profile(name: str, df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One pass over a table: rows read, valid, rejected, rejection rate and nulls."""
    broken = rules[0][0]
    for more, _ in rules[1:]:
        broken = broken | more
    read, bad = F.count(F.lit(1)), F.coalesce(F.count_if(broken), F.lit(0).cast("long"))
    counted = df.agg(read.alias("nb_lignes_lues"), bad.alias("nb_lignes_rejetees"), _nulls(df.columns).alias("nb_valeurs_nulles"))
    rate = F.coalesce(F.round(F.try_divide(F.col("nb_lignes_rejetees").cast("double"), F.col("nb_lignes_lues").cast("double")) * 10000) / 100, F.lit(0.0))
    return counted.select(
        F.lit(name).alias("dataset"),
        "nb_lignes_lues",
        (F.col("nb_lignes_lues") - F.col("nb_lignes_rejetees")).alias("nb_lignes_valides"),
        "nb_lignes_rejetees",
        rate.alias("taux_rejet"),
        "nb_valeurs_nulles",
    )


def quality_report(transactions: DataFrame, users: DataFrame, products: DataFrame, merchants: DataFrame) -> DataFrame:
    """One row per table; the orphan counts stand on the ``transactions`` row only."""
    profiles = [
        _profile("transactions", transactions, transaction_rules()),
        _profile("users", users, user_rules()),
        _profile("products", products, product_rules()),
        _profile("merchants", merchants, merchant_rules()),
    ]
    report = profiles[0]
    for more in profiles[1:]:
        report = report.unionByName(more)
    checks = referential_integrity(transactions, users, products, merchants).withColumn("_of", F.lit("transactions"))
    return report.join(F.broadcast(checks), F.col("dataset") == F.col("_of"), "left").drop("_of")
