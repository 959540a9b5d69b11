"""Time features of a ``yyyyMMddHHmmss`` string, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = "yyyyMMddHHmmss"
#: English names from Sunday and from January on.
DAYS = ["SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY"]
MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]
TIME_FEATURES = ["hour", "day_of_week", "month", "is_weekend", "day_period", "is_working_hours"]


def parse_full(ts: Column) -> Column:
    """The whole string as a time; null if it is null, empty or malformed."""
    return F.try_to_timestamp(ts, F.lit(PATTERN))


def parse_prefix(ts: Column) -> Column:
    """The first 14 characters as a time; null if they are malformed."""
    return F.try_to_timestamp(F.substring(ts, 1, 14), F.lit(PATTERN))


def _flag(condition: Column, known: Column) -> Column:
    return F.when(known, F.when(condition, 1).otherwise(0))


def time_feature_columns(ts: Column) -> dict[str, Column]:
    """The six features of a parsed time; all null where it is null."""
    known, hour = ts.isNotNull(), F.hour(ts)
    period = F.when(hour.between(6, 11), "Morning").when(hour.between(12, 17), "Afternoon").when(hour.between(18, 21), "Evening").otherwise("Night")
    return {
        "hour": hour,
        "day_of_week": F.when(known, F.element_at(F.array(*map(F.lit, DAYS)), F.dayofweek(ts))),
        "month": F.when(known, F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts))),
        "is_weekend": _flag(F.dayofweek(ts).isin(1, 7), known),
        "day_period": F.when(known, period),
        "is_working_hours": _flag(hour.between(9, 17), known),
    }


def with_time_features(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumns(time_feature_columns(parse_full(F.col(column).cast("string"))))


def with_parsed_dates(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """``transaction_datetime``, ``transaction_date`` and ``transaction_month`` from the first 14 characters."""
    ts = parse_prefix(F.col(column))
    return df.withColumns({"transaction_datetime": ts, "transaction_date": F.to_date(ts), "transaction_month": F.to_date(F.trunc(ts, "month"))})


def age_group(age: Column) -> Column:
    """Under 25, 26 to 44, 45 to 64, from 65; 25 itself belongs to no group."""
    return F.when(age < 25, "Jeune").when(age.between(26, 44), "Adulte").when(age.between(45, 64), "Âge Moyen").when(age >= 65, "Senior")


def r2(value: Column) -> Column:
    return F.round(value, 2)
