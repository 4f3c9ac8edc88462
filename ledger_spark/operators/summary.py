"""The summary record: totals, monthly means, top category, date range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_spark.functions.parsing import as_double, savings_rate, zero_if_null
from ledger_spark.functions.render import day_text
from ledger_spark.operators.rollup import base_cells, has_flow, merged_measures

SUMMARY_COLUMNS = (
    "total_income",
    "total_expenses",
    "net_flow",
    "avg_monthly_income",
    "avg_monthly_expenses",
    "avg_savings_rate",
    "top_expense_category",
    "top_expense_amount",
    "transaction_count",
    "date_range",
)


def profile(
    tx: DataFrame | None = None, keys: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """Summary columns plus date bounds and the number of expense categories.

    The transactions are rolled up to cells once. Two grouping sets over the
    cells, by month and by category, are then folded to one row per key. The
    table is read once and no join is needed.
    """
    cells = base_cells(tx, keys) if cells is None else cells
    by_month, by_category = [*keys, "year_month"], [*keys, "category"]
    grouped = cells.groupingSets([by_month, by_category], *by_month, "category").agg(
        F.grouping("category").alias("__monthly"), *merged_measures()
    )
    monthly = F.col("__monthly") == 1
    month = monthly & F.col("year_month").isNotNull() & has_flow()
    label = ~monthly & F.col("category").isNotNull() & F.col("expense_sum").isNotNull()
    income = zero_if_null(F.col("income_sum"))
    expenses = F.abs(zero_if_null(F.col("expense_sum")))
    # wide enough for any rate of two sums of money
    rate = savings_rate(income, income - expenses).cast(T.DecimalType(38, 2))

    folded = grouped.groupBy(*keys).agg(
        F.sum(F.when(monthly, F.col("income_sum"))).alias("income"),
        F.sum(F.when(monthly, F.col("expense_sum"))).alias("expense"),
        F.sum(F.when(monthly, F.col("rows"))).alias("rows"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.count_if(month).alias("months"),
        F.sum(F.when(month, income)).alias("month_income"),
        F.sum(F.when(month, expenses)).alias("month_expenses"),
        F.sum(F.when(month, rate)).alias("month_rates"),
        F.min(F.when(label, F.struct("expense_sum", "category"))).alias("top"),
        F.count_if(label).alias("expense_categories"),
    )
    months = F.nullif(F.col("months"), F.lit(0))
    return folded.select(
        *keys,
        as_double(zero_if_null(F.col("income"))).alias("total_income"),
        as_double(F.abs(zero_if_null(F.col("expense")))).alias("total_expenses"),
        as_double(zero_if_null(F.col("income")) + zero_if_null(F.col("expense"))).alias("net_flow"),
        (as_double(F.col("month_income")) / months).alias("avg_monthly_income"),
        (as_double(F.col("month_expenses")) / months).alias("avg_monthly_expenses"),
        (as_double(F.col("month_rates")) / months).alias("avg_savings_rate"),
        F.col("top.category").alias("top_expense_category"),
        as_double(F.abs(zero_if_null(F.col("top.expense_sum")))).alias("top_expense_amount"),
        zero_if_null(F.col("rows")).alias("transaction_count"),
        F.concat(day_text(F.col("first_date")), F.lit(" to "), day_text(F.col("last_date"))).alias(
            "date_range"
        ),
        "first_date",
        "last_date",
        "expense_categories",
    )


def summary(
    tx: DataFrame | None = None, keys: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """The ten summary values, one row per key.

    A whole-table summary of no rows has count 0 and null means and range.
    """
    return profile(tx, keys, cells).select(*keys, *SUMMARY_COLUMNS)


def date_bounds(tx: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last day."""
    return tx.groupBy(*keys).agg(
        F.to_date(F.min("date")).alias("min_date"), F.to_date(F.max("date")).alias("max_date")
    )
