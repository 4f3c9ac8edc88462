"""Income sources, recurring, unusual and small expenses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.parsing import as_double, zero_if_null
from ledger_spark.keyed import ROWS_PER_TASK, first_per_key, lookup_by_key
from ledger_spark.operators.moments import MOMENTS, SMALL_EXPENSE, merged_moments, moment_measures, with_spread
from ledger_spark.operators.rollup import base_cells, description_cells
from ledger_spark.staging import stage

# List lengths.
INCOME_SOURCES = 3
RECURRING = 5
LARGE_EXPENSES = 3

IS_INCOME = "amount > 0"
IS_EXPENSE = "amount < 0"


def _income_sums(tx: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = tx.filter(IS_INCOME).filter(F.col("description").isNotNull())
    return named.groupBy(*keys, "description").agg(F.sum("amount").alias("amount"))


def income_by_description(tx: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Income per description; rows without one are left out."""
    return _income_sums(tx, keys).withColumn("amount", as_double(F.col("amount")))


def top_income_sources(
    tx: DataFrame, keys: Sequence[str] = (), n: int = INCOME_SOURCES
) -> DataFrame:
    """The ``n`` descriptions with the highest income; ties go by name."""
    top = first_per_key(_income_sums(tx, keys), keys, [F.desc("amount"), F.asc("description")], n)
    return top.withColumn("amount", as_double(F.col("amount")))


def expense_frequency(tx: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often each description occurs among expenses."""
    named = tx.filter(IS_EXPENSE).filter(F.col("description").isNotNull())
    return named.groupBy(*keys, "description").agg(F.count(F.lit(1)).alias("frequency"))


def recurring_descriptions(tx: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Descriptions that occur more than once among expenses."""
    return expense_frequency(tx, keys).filter(F.col("frequency") > 1)


def recurring_expenses(tx: DataFrame, keys: Sequence[str] = (), n: int = RECURRING) -> DataFrame:
    """The ``n`` most frequent recurring descriptions; ties go by name."""
    order = [F.desc("frequency"), F.asc("description")]
    return first_per_key(recurring_descriptions(tx, keys), keys, order, n)


def expense_stats(
    tx: DataFrame | None = None,
    keys: Sequence[str] = (),
    small: float = SMALL_EXPENSE,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Row and expense counts, exact sum, mean, sample deviation, small count and outlier bound.

    All figures come from exact sums, so they do not depend on how the table is
    partitioned. ``cells`` are ``base_cells`` with moments; they bring their own
    bound for small expenses.
    """
    if cells is not None:
        if not set(MOMENTS) <= set(cells.columns):
            raise ValueError("expense statistics need cells with moments")
        sums = [F.sum(c).alias(c) for c in ("rows", "expense_sum")]
        merged = cells.groupBy(*keys).agg(*sums, *merged_moments())
        # a whole table without rows has sums of nothing
        counts = ("rows", "expenses", "small_expenses")
        merged = merged.withColumns({c: zero_if_null(F.col(c)).cast("bigint") for c in counts})
    else:
        expense = F.when(F.expr(IS_EXPENSE), F.col("amount"))
        merged = tx.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(expense).alias("expense_sum"), *moment_measures(small)
        )
    return with_spread(merged)


def small_expense_count(
    tx: DataFrame, keys: Sequence[str] = (), small: float = SMALL_EXPENSE
) -> DataFrame:
    """Number of expenses smaller than the bound, 0 where there are none."""
    expense = F.when(F.expr(IS_EXPENSE), F.col("amount"))
    return tx.groupBy(*keys).agg(F.count_if(expense > small).alias("small_expenses"))


def large_expenses(
    tx: DataFrame,
    keys: Sequence[str] = (),
    stats: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Expenses more than two sample deviations below the mean expense.

    The bound is exact (see ``with_spread``), so equal amounts never count as
    unusual through rounding, and neither order nor partitioning matters. A single
    expense has no deviation and yields nothing. ``stats`` is the table from
    ``expense_stats``; per key it is staged because it is read more than once.
    Only keys that have an unusual expense at all take part in the lookup.
    """
    if stats is None:
        stats = expense_stats(tx, keys)
        stats = stage(stats, "expense-stats") if keys else stats
    needed = stats.select(*keys, F.col("rows").alias("__rows"), F.col("large_bound").alias("__bound"))
    if keys:
        needed = needed.filter(stats["largest_expense"] < stats["large_bound"])
    columns = list(
        dict.fromkeys([*keys, "statement_id", "seq", "date", "description", "amount"])
    )
    expenses = tx.filter(IS_EXPENSE).select(*columns)
    joined = lookup_by_key(
        expenses, needed, keys, "__rows", ["statement_id", "seq"], rows_per_task
    )
    return joined.filter(F.col("amount") < F.col("__bound")).select(*columns)


def first_large_expenses(
    tx: DataFrame,
    keys: Sequence[str] = (),
    n: int = LARGE_EXPENSES,
    stats: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The first ``n`` unusual expenses in record order."""
    large = large_expenses(tx, keys, stats, rows_per_task)
    return first_per_key(large, keys, [F.asc("statement_id"), F.asc("seq")], n)


def _entries(kind: str, *fields: str) -> Column:
    """Rows of one kind, in rank order; the branches bound how many there are."""
    item = F.struct("rank", *fields)
    return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))


def _by_money(entries: Column) -> Column:
    """Entries with the largest amount first; ties go by name."""
    keyed = F.transform(
        entries,
        lambda e: F.struct((-e["money"]).alias("order"), e["label"].alias("label"), e["money"].alias("money")),
    )
    return F.array_sort(keyed)


def _pairs(entries: Column) -> Column:
    return F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["label"].alias("key"), e["money"].alias("value")))
    )


def category_sums(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spending per category from cells."""
    spent = cells.filter(F.col("expense_sum").isNotNull() & F.col("category").isNotNull())
    return spent.groupBy(*keys, "category").agg(F.abs(F.sum("expense_sum")).alias("amount"))


def category_map(
    tx: DataFrame | None = None, keys: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """One row per key with the whole map of category spending, largest first."""
    source = base_cells(tx, keys) if cells is None else cells
    spent = category_sums(source, keys).select(
        *keys, F.struct(F.col("category").alias("label"), as_double(F.col("amount")).alias("money")).alias("item")
    )
    gathered = spent.groupBy(*keys).agg(F.collect_list("item").alias("items"))
    return gathered.select(*keys, _pairs(_by_money(F.col("items"))).alias("category_expenses"))


def short_lists(tx: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Top income sources and recurring expenses: keys, kind, rank, label, money.

    Both come from one rollup by description, in one ranking: a description has an
    income entry if it has income and a recurring one if it is among the expenses
    more than once. Every task trims its entries before the shuffle.
    """
    lengths = {"income": INCOME_SOURCES, "recurring": RECURRING}
    value = {
        "income": F.col("income_sum").cast("decimal(38,2)"),
        "recurring": F.when(F.col("frequency") > 1, F.col("frequency").cast("decimal(38,2)")),
    }
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in value.items()])
    rows = description_cells(tx, keys).select(*keys, "description", F.explode(entries).alias("entry"))
    rows = rows.select(*keys, "entry.kind", "entry.value", F.col("description").alias("label"))
    order = [F.desc("value"), F.asc("label")]
    ranked = first_per_key(
        rows.filter(F.col("value").isNotNull()), [*keys, "kind"], order, max(lengths.values()), "rank"
    )
    length = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])[F.col("kind")]
    money = F.when(F.col("kind") == "income", as_double(F.col("value")))
    return ranked.filter(F.col("rank") <= length).select(*keys, "kind", "rank", "label", money.alias("money"))


def pattern_record(
    tx: DataFrame,
    keys: Sequence[str] = (),
    cells: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per key with all spending patterns as maps and short lists.

    The transactions are read three times: for the cells (``base_cells`` with
    moments, unless given), for the rollup by description, and for the unusual
    expenses themselves. Short lists are cut to their bounded length first, then
    laid under each other, with the category sums, and gathered in one
    aggregation. That takes a single small shuffle instead of a join per list, and
    a key that lacks a list gets an empty one. The category map is always whole:
    it is this record's own value, and ``category_spending`` has the same rows as
    a table.
    """
    if cells is None:
        cells = stage(base_cells(tx, keys, moments=True), "cells")
    stats = stage(expense_stats(keys=keys, cells=cells), "expense-stats")
    large = first_per_key(
        large_expenses(tx, keys, stats, rows_per_task),
        keys,
        [F.asc("statement_id"), F.asc("seq")],
        LARGE_EXPENSES,
        "rank",
    )

    def rows(df: DataFrame, kind: Column, rank: Column, label: Column, money: Column, date: Column):
        return df.select(
            *keys,
            kind.alias("kind"),
            rank.cast("bigint").alias("rank"),
            label.cast("string").alias("label"),
            as_double(money).alias("money"),
            date.cast("timestamp_ntz").alias("date"),
        )

    none = F.lit(None)
    rank, money = F.col("rank"), F.col("amount")
    parts = [
        rows(stats, F.lit("small"), F.col("small_expenses"), none, none, none),
        rows(category_sums(cells, keys), F.lit("category"), none, F.col("category"), money, none),
        rows(short_lists(tx, keys), F.col("kind"), rank, F.col("label"), F.col("money"), none),
        rows(large, F.lit("large"), rank, F.col("description"), money, F.col("date")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    gathered = stacked.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "small", F.col("rank"))).alias("small_expense_count"),
        _entries("income", "label", "money").alias("income"),
        _entries("category", "label", "money").alias("category"),
        _entries("recurring", "label").alias("recurring"),
        _entries("large", "date", "label", "money").alias("large"),
    )
    return gathered.select(
        *keys,
        _pairs(F.col("income")).alias("top_income_sources"),
        _pairs(_by_money(F.col("category"))).alias("category_expenses"),
        F.transform("recurring", lambda e: e["label"]).alias("recurring_expenses"),
        F.transform(
            "large",
            lambda e: F.struct(
                e["date"].alias("date"), e["label"].alias("description"), e["money"].alias("amount")
            ),
        ).alias("large_transactions"),
        F.coalesce("small_expense_count", F.lit(0)).alias("small_expense_count"),
    )
