"""Spending by category, its breakdown and its trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.functions.parsing import as_double
from ledger_spark.keyed import first_per_key
from ledger_spark.operators.rollup import cells_by
from ledger_spark.schema import UNCATEGORISED


def _spending(tx: DataFrame | None, cells: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Exact spending per group, as a positive decimal ``amount``."""
    groups = cells_by(tx, cells, by).filter(
        F.col("expense_sum").isNotNull() & F.col("category").isNotNull()
    )
    return groups.select(*by, F.abs("expense_sum").alias("amount"))


def category_spending(
    tx: DataFrame | None = None, keys: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """Spending per category; the whole-table report is sorted, largest first."""
    exact = _spending(tx, cells, [*keys, "category"])
    if not keys:
        exact = exact.orderBy(F.desc("amount"), "category")
    return exact.withColumn("amount", as_double(F.col("amount")))


def monthly_category_spending(
    tx: DataFrame | None = None, keys: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """Spending per month and category; rows without a month are left out."""
    by = [*keys, "year_month", "category"]
    exact = _spending(tx, cells, by).filter(F.col("year_month").isNotNull())
    if not keys:
        exact = exact.orderBy("year_month", "category")
    return exact.withColumn("amount", as_double(F.col("amount")))


def top_categories(
    tx: DataFrame | None = None,
    keys: Sequence[str] = (),
    n: int = 5,
    cells: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` categories with the highest spending; ties go by name."""
    exact = _spending(tx, cells, [*keys, "category"])
    top = first_per_key(exact, keys, [F.desc("amount"), F.asc("category")], n)
    return top.withColumn("amount", as_double(F.col("amount")))


def spending_breakdown(
    tx: DataFrame | None = None,
    keys: Sequence[str] = (),
    slices: int = 10,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Pie slices: every category, or the largest ones and one for the rest.

    With more than ``slices`` categories the top ``slices - 1`` are kept and the
    others are summed under "Other", flagged ``is_bucket`` because a category of
    that name may be among the top ones. The rest is total minus kept, which is
    exact in decimal, so no task ever sees a key's full list of categories.
    """
    exact = _spending(tx, cells, [*keys, "category"])
    order = [F.desc("amount"), F.asc("category")]
    top = first_per_key(exact, keys, order, slices, rank="__rank")
    totals = exact.groupBy(*keys).agg(
        F.sum("amount").alias("__total"), F.count(F.lit(1)).alias("__labels")
    )
    # Laid under each other rather than joined: one small shuffle by key.
    stacked = top.unionByName(totals, allowMissingColumns=True)
    whole = Window.partitionBy(*keys)
    ranked = stacked.withColumns(
        {"__total": F.max("__total").over(whole), "__labels": F.max("__labels").over(whole)}
    )
    crowded = F.col("__labels") > slices
    in_bucket = crowded & (F.col("__rank") == slices)
    before = whole.orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("__kept", F.coalesce(F.sum("amount").over(before), F.lit(0)))
    ranked = ranked.filter(F.col("__rank").isNotNull())
    amount = F.when(in_bucket, F.col("__total") - F.col("__kept")).otherwise(F.col("amount"))
    label = F.when(in_bucket, F.lit(UNCATEGORISED)).otherwise(F.col("category"))
    share = as_double(amount) / as_double(F.col("__total")) * F.lit(100.0)
    return ranked.select(
        *keys,
        label.alias("category"),
        in_bucket.alias("is_bucket"),
        as_double(amount).alias("amount"),
        share.alias("share"),
    )


def category_trend(
    tx: DataFrame | None = None,
    keys: Sequence[str] = (),
    n: int = 5,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Monthly spending of the ``n`` categories with the highest spending.

    The category total is attached to its monthly rows and the rows are ranked
    by it, which equals a semi-join with the top list but reads the
    transactions once. A category's total includes rows without a month.
    """
    monthly = _spending(tx, cells, [*keys, "year_month", "category"])
    per_category = Window.partitionBy(*keys, "category")
    by_total = Window.partitionBy(*keys).orderBy(F.desc("__total"), F.asc("category"))
    ranked = monthly.withColumn("__total", F.sum("amount").over(per_category)).withColumn(
        "__rank", F.dense_rank().over(by_total)
    )
    kept = ranked.filter((F.col("__rank") <= n) & F.col("year_month").isNotNull())
    return kept.select(*keys, "year_month", "category", as_double(F.col("amount")).alias("amount"))
