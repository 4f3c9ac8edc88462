"""Reports with one row per month.

Each takes either normalised transactions or cells that were rolled up before.
Months without rows are absent; rows without a date belong to no month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.parsing import as_double, savings_rate, zero_if_null
from ledger_spark.operators.rollup import cells_by, has_flow, net_sum

# Fixed value: the savings rate drawn as the target line, in percent.
SAVINGS_TARGET = 20.0


def _sorted(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Whole-table reports come sorted; per-key ones are left as they fall."""
    return df if keys else df.orderBy(*order)


def monthly_cash_flow(
    tx: DataFrame | None = None, keys: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """Net flow and number of amounts per month."""
    months = cells_by(tx, cells, [*keys, "year_month"]).filter(F.col("year_month").isNotNull())
    report = months.select(
        *keys,
        "year_month",
        as_double(net_sum()).alias("net_flow"),
        F.col("amounts").alias("num_transactions"),
    )
    return _sorted(report, keys, "year_month")


def monthly_income_vs_expenses(
    tx: DataFrame | None = None, keys: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """Income, expenses, savings and savings rate per month.

    Both sides come from one conditional aggregation, so no month spine has to
    be built and joined. A month with neither income nor expense is absent.
    """
    months = cells_by(tx, cells, [*keys, "year_month"]).filter(
        F.col("year_month").isNotNull() & has_flow()
    )
    income = zero_if_null(F.col("income_sum"))
    expenses = F.abs(zero_if_null(F.col("expense_sum")))
    savings = income - expenses
    report = months.select(
        *keys,
        "year_month",
        as_double(income).alias("income"),
        as_double(expenses).alias("expenses"),
        as_double(savings).alias("savings"),
        savings_rate(income, savings).alias("savings_rate"),
    )
    return _sorted(report, keys, "year_month")


def monthly_bars(
    tx: DataFrame | None = None, keys: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """Income and expense bar heights per month."""
    report = monthly_income_vs_expenses(tx, keys, cells)
    return report.select(*keys, "year_month", "income", "expenses")


def savings_rate_series(
    tx: DataFrame | None = None,
    keys: Sequence[str] = (),
    cells: DataFrame | None = None,
    target: float = SAVINGS_TARGET,
) -> DataFrame:
    """Savings rate per month next to the constant target."""
    report = monthly_income_vs_expenses(tx, keys, cells)
    return report.select(*keys, "year_month", "savings_rate", F.lit(target).alias("target"))
