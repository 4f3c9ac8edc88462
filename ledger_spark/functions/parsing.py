"""Lenient text-to-value conversions and small money helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_spark.schema import MONEY

# Year-first dates with month and day, optionally followed by a time.
_ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"


def to_money(value: Column) -> Column:
    """Number or numeric text as DECIMAL(18,2); anything else becomes null."""
    return value.try_cast(MONEY)


def to_moment(value: Column, dtype: T.DataType) -> Column:
    """Date or timestamp as TIMESTAMP_NTZ; text must be a year-first date.

    A bare year is no date here although a plain cast would take it.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return value
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike(_ISO_DATE), value.try_cast(T.TimestampNTZType()))
    return value.try_cast(T.TimestampNTZType())


def signed(amount: Column, kind: Column) -> Column:
    """Sign rule: debits are negative, credits positive, the rest unchanged."""
    return (
        F.when(kind == "debit", -F.abs(amount)).when(kind == "credit", F.abs(amount)).otherwise(amount)
    )


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def as_double(value: Column) -> Column:
    return value.cast("double")


def round_half_even(value: Column, digits: int) -> Column:
    """Round a double to ``digits`` places, ties to the even neighbour."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def savings_rate(income: Column, savings: Column) -> Column:
    """Savings as a percentage of income; 0 for a month without income."""
    rate = as_double(savings) / F.nullif(as_double(income), F.lit(0.0)) * F.lit(100.0)
    return F.when(income == 0, F.lit(0.0)).otherwise(round_half_even(rate, 2))
