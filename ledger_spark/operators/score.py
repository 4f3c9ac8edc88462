"""Rule-based health score and its bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.keyed import ROWS_PER_TASK
from ledger_spark.operators.patterns import LARGE_EXPENSES, expense_stats, large_expenses
from ledger_spark.operators.rollup import base_cells, description_cells
from ledger_spark.operators.summary import profile
from ledger_spark.staging import stage

# The points of each rule.
START = 50
POSITIVE_NET = 10
SAVINGS_STEPS = ((30, 15), (20, 10), (10, 5))
NEGATIVE_SAVINGS = -15
MANY_SOURCES = (2, 5)
MANY_CATEGORIES = (8, -5)
MANY_LARGE = (2, -5)
MANY_SMALL = (20, -5)
LOWEST, HIGHEST = 0, 100

# Lower bounds of the colour and message bands, highest first.
COLOURS = ((70, "#28a745"), (40, "#ffc107"), (None, "#dc3545"))
MESSAGES = (
    (80, "Excellent financial health! Keep it up!"),
    (60, "Good financial standing with room for improvement."),
    (40, "Average financial health. Consider the tips below."),
    (20, "Financial warning signs. Action recommended."),
    (None, "Immediate financial attention needed."),
)
MISSING_SCORE = 50


def score_expression(
    net_flow: Column,
    savings_rate: Column,
    income_sources: Column,
    expense_categories: Column,
    large_count: Column,
    small_count: Column,
) -> Column:
    """Points of all rules, clamped; a missing savings rate adds nothing."""

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    (first, first_points), *later = SAVINGS_STEPS
    steps = F.when(savings_rate > first, first_points)
    for bound, value in later:
        steps = steps.when(savings_rate > bound, value)
    savings = steps.when(savings_rate < 0, NEGATIVE_SAVINGS).otherwise(0)
    total = (
        F.lit(START)
        + points(net_flow > 0, POSITIVE_NET)
        + savings
        + points(income_sources > MANY_SOURCES[0], MANY_SOURCES[1])
        + points(expense_categories > MANY_CATEGORIES[0], MANY_CATEGORIES[1])
        + points(large_count > MANY_LARGE[0], MANY_LARGE[1])
        + points(small_count > MANY_SMALL[0], MANY_SMALL[1])
    )
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), total)).cast("int")


def health_score(
    tx: DataFrame,
    keys: Sequence[str] = (),
    cells: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Health score per key with the facts it rests on.

    Only counts matter here, so no list is gathered and no row is ranked: each
    fact is a narrow row per key, and one aggregation over all of them feeds the
    rules. Kept large expenses number at most three, hence "more than two" means
    three or more. The transactions are read three times, as in
    ``pattern_record``; ``cells`` are ``base_cells`` with moments.
    """
    if cells is None:
        cells = stage(base_cells(tx, keys, moments=True), "cells")
    profiles = profile(keys=keys, cells=cells)
    stats = stage(expense_stats(keys=keys, cells=cells), "expense-stats")
    named = description_cells(tx, keys).filter(F.col("income_sum").isNotNull())
    sources = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("income_sources"))
    found = large_expenses(tx, keys, stats, rows_per_task).groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    large = found.withColumn("large_expenses", F.least("found", F.lit(LARGE_EXPENSES)))

    facts = {
        "net_flow": "double",
        "savings_rate": "double",
        "expense_categories": "bigint",
        "income_sources": "bigint",
        "large_expenses": "bigint",
        "small_expenses": "bigint",
    }

    def narrow(df: DataFrame) -> DataFrame:
        return df.select(
            *keys,
            *[
                (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
                for c, t in facts.items()
            ],
        )

    stacked = narrow(profiles.withColumnRenamed("avg_savings_rate", "savings_rate"))
    for part in (stats, sources, large):
        stacked = stacked.unionByName(narrow(part))
    gathered = stacked.groupBy(*keys).agg(
        F.max("net_flow").alias("net_flow"),
        F.max("savings_rate").alias("savings_rate"),
        F.coalesce(F.max("expense_categories"), F.lit(0)).alias("expense_categories"),
        F.coalesce(F.sum("income_sources"), F.lit(0)).alias("income_sources"),
        F.coalesce(F.sum("large_expenses"), F.lit(0)).alias("large_expenses"),
        F.coalesce(F.max("small_expenses"), F.lit(0)).alias("small_expenses"),
    )
    return gathered.withColumn(
        "health_score",
        score_expression(
            F.col("net_flow"),
            F.col("savings_rate"),
            F.col("income_sources"),
            F.col("expense_categories"),
            F.col("large_expenses"),
            F.col("small_expenses"),
        ),
    )


def _band(score: Column, bands: Sequence[tuple[int | None, str]]) -> Column:
    (bound, label), *rest = bands
    chosen = F.when(score >= bound, F.lit(label))
    for bound, label in rest:
        chosen = chosen.when(score >= bound, F.lit(label)) if bound is not None else (
            chosen.otherwise(F.lit(label))
        )
    return chosen


def health_bands(scores: DataFrame, column: str = "health_score") -> DataFrame:
    """Colour and message of each score; a missing score counts as neutral."""
    score = F.coalesce(F.col(column), F.lit(MISSING_SCORE))
    return scores.withColumns(
        {"health_color": _band(score, COLOURS), "health_message": _band(score, MESSAGES)}
    )
