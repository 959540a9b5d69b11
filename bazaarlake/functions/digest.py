"""A digest of a table's rows in any order, which other engines can compute as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL = "\\N"


def cell_text(column: str, kind: str) -> Column:
    """Text of a value: doubles with two decimals, null as ``\\N``."""
    value = F.col(f"`{column}`")
    if kind in ("double", "float"):
        return F.coalesce(F.round(value, 2).try_cast("decimal(30,2)").cast("string"), value.cast("string"), F.lit(NULL))
    return F.coalesce(value.cast("string"), F.lit(NULL))


def content_digest(df: DataFrame) -> DataFrame:
    """One row: ``rows``, and ``digest``, the sum of 60 bits of each row's MD5; repeated rows count each time. 0 for an empty table."""
    row = F.md5(F.concat_ws("|", *[cell_text(c, t) for c, t in df.dtypes]))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))
