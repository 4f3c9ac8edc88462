"""The mergeable rollup that all sum-and-count reports come from.

One aggregation of the transaction table (partial sums before the shuffle)
gives cells of ``keys x year_month x category``. Sums are decimal, so merging
cells in any order gives the exact total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.parsing import zero_if_null
from ledger_spark.operators.moments import SMALL_EXPENSE, moment_measures


def measures() -> list[Column]:
    """Aggregates over transaction rows.

    A side without any amount stays null, so ``expense_sum is not null`` tells
    that a group has expenses, and no extra counts have to be carried.
    """
    amount = F.col("amount")
    return [
        F.sum(F.when(amount > 0, amount)).alias("income_sum"),
        F.sum(F.when(amount < 0, amount)).alias("expense_sum"),
        F.count(F.lit(1)).alias("rows"),
        F.count(amount).alias("amounts"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    ]


def merged_measures() -> list[Column]:
    """The same aggregates over cells."""
    return [
        *[F.sum(c).alias(c) for c in ("income_sum", "expense_sum", "rows", "amounts")],
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    ]


def has_flow() -> Column:
    """True for cells with at least one amount other than zero."""
    return F.col("income_sum").isNotNull() | F.col("expense_sum").isNotNull()


def net_sum() -> Column:
    """Exact net amount of a cell; 0 where it has no amounts."""
    return zero_if_null(F.col("income_sum")) + zero_if_null(F.col("expense_sum"))


def with_category(tx: DataFrame) -> DataFrame:
    """A table without categories gets null ones, which no category report shows."""
    if "category" in tx.columns:
        return tx
    return tx.withColumn("category", F.lit(None).cast("string"))


def rollup(tx: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells of a normalised transaction table."""
    source = with_category(tx) if "category" in by else tx
    return source.groupBy(*by).agg(*measures())


def base_cells(
    tx: DataFrame, keys: Sequence[str] = (), moments: bool = False, small: float = SMALL_EXPENSE
) -> DataFrame:
    """Cells fine enough for every monthly, category and summary report.

    With ``moments`` they serve the expense statistics too; an expense counts as
    small above ``small``.
    """
    by = [*keys, "year_month", "category"]
    more = moment_measures(small) if moments else []
    return with_category(tx).groupBy(*by).agg(*measures(), *more)


def description_cells(tx: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Income sum and number of expenses of each description; rows without one are left out."""
    amount = F.col("amount")
    named = tx.filter(F.col("description").isNotNull() & (amount != 0))
    return named.groupBy(*keys, "description").agg(
        F.sum(F.when(amount > 0, amount)).alias("income_sum"), F.count_if(amount < 0).alias("frequency")
    )


def cells_by(tx: DataFrame | None, cells: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Cells grouped by ``by``: merged from finer cells if given, else from rows."""
    if cells is not None:
        return cells.groupBy(*by).agg(*merged_measures())
    if tx is None:
        raise ValueError("pass a transaction table or its cells")
    return rollup(tx, by)
