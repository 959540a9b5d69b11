"""Sums of doubles that do not depend on the order in which they are added."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(value: str) -> Column:
    """The sum of a column's shortest decimal forms, to 16 places; null if one is NaN, infinite or of more than 22 digits before the point."""
    decimal = F.expr(f"try_cast(`{value}` as decimal(38,16))")
    return F.when(F.count(value) == F.count(decimal), F.try_sum(decimal))


def money_texts(total: Column, plain: Column, filled: Column) -> tuple[Column, Column]:
    """Sum and average of ``filled`` amounts such as ``1,234.56``, from their exact sum or, where that is null, from the ``plain`` one."""
    total = F.coalesce(total.cast("double"), plain)
    return F.format_number(total, 2), F.format_number(F.try_divide(total, filled), 2)
