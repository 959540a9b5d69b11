"""Reading the inputs and intermediate tables, and writing results."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .scratch import dropped_after, without_shuffles


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; bad values become null, surplus fields are ignored. A missing path raises."""
    return spark.read.schema(schemas.TRANSACTIONS).option("header", True).csv(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a nested array."""
    return spark.read.schema(schemas.USERS).json(path)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_merchants(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and a fixed schema: inferred ids would turn into numbers."""
    return spark.read.schema(schemas.MERCHANTS).option("header", True).csv(path)


VALIDATED = ("transactions", "users", "products", "merchants")


def write_validated(tables: dict[str, DataFrame], path: str) -> None:
    """All four at the same time, as jobs of their own."""
    with ThreadPoolExecutor(len(VALIDATED)) as pool:
        for done in [pool.submit(lambda n=n: tables[n].write.mode("overwrite").parquet(f"{path}/validated_{n}")) for n in VALIDATED]:
            done.result()


def read_validated(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/validated_{name}") for name in VALIDATED}


def write_csv(df: DataFrame, path: str, name: str, compression: str = "none") -> None:
    """CSV with a header; array columns, which CSV cannot hold, are written as JSON text. Gzip takes its fastest level."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).options(**{"compression": compression, "zlib.compress.level": "BEST_SPEED"}).csv(f"{path}/{name}")


#: Zstd needs less disk than snappy, and no dictionaries of columns that hardly repeat make up for its time.
ENRICHED_FORMAT = {"compression": "zstd"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("transaction_id", "amount", "timestamp")}


def write_enriched(enriched: DataFrame | Callable[[], DataFrame], path: str) -> None:
    """As Parquet, and from that as CSV, gzipped as it has a row for each transaction; the table is computed once.

    Its shuffle files go before the CSV is made, and its intermediate tables as
    well where ``enriched`` is what makes it, so that nobody else reads them.
    """
    with dropped_after():
        table = enriched if isinstance(enriched, DataFrame) else enriched()
        spark = table.sparkSession
        with without_shuffles(spark):
            table.write.mode("overwrite").options(**ENRICHED_FORMAT).parquet(f"{path}/enriched_transactions")
    write_csv(read_enriched(spark, path), path, "enriched_transactions_csv", "gzip")


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/enriched_transactions")


def write_wide(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").parquet(f"{path}/enriched_wide")


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/enriched_wide")


def write_quality_report(report: DataFrame, path: str) -> None:
    write_csv(report, path, "data_quality_report")


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that ``write_csv`` wrote, without array columns."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_result(df: DataFrame, path: str, name: str) -> DataFrame:
    """One result as Parquet (``name_parquet``) and as CSV (``name``); computed once, and returned as it was written."""
    df.write.mode("overwrite").parquet(f"{path}/{name}_parquet")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}_parquet")
    write_csv(written, path, name)
    return written
