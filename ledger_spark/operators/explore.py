"""Faceted filtering of transactions with totals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.parsing import as_double, zero_if_null
from ledger_spark.functions.render import plain_money_text
from ledger_spark.functions.text import contains_term

# The entry that switches a facet off, and the type facet.
ALL = "All"
TYPE_FACET = (ALL, "credit", "debit")


def filter_transactions(
    tx: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    category: str | None = ALL,
    type: str | None = ALL,
    term: str | None = None,
    by_month: bool = False,
) -> DataFrame:
    """Rows that pass every active filter.

    The date range counts whole days, both ends included, and applies only when
    both are given. It is written as bounds on the timestamp itself, so it
    reaches the Parquet scan. The search term is literal and ignores case. For a
    table from ``read_by_month``, ``by_month`` limits the months as well, so that
    only their folders are read.
    """
    if start is not None and end is not None:
        if by_month:
            tx = tx.filter(F.col("year_month").between(f"{start:%Y-%m}", f"{end:%Y-%m}"))
        after = dt.datetime.combine(end, dt.time()) + dt.timedelta(days=1)
        first = F.lit(dt.datetime.combine(start, dt.time()).isoformat(" "))
        tx = tx.filter(
            (F.col("date") >= first.cast("timestamp_ntz"))
            & (F.col("date") < F.lit(after.isoformat(" ")).cast("timestamp_ntz"))
        )
    if category not in (None, ALL):
        tx = tx.filter(F.col("category") == category)
    if type not in (None, ALL):
        tx = tx.filter(F.col("type") == type)
    if term:
        tx = tx.filter(contains_term(F.col("description"), term))
    return tx


def display_transactions(tx: DataFrame) -> DataFrame:
    """Rows for display: plain dates, rupee amounts, newest day first."""
    ties = [c for c in ("statement_id", "seq") if c in tx.columns]
    shown = tx.withColumns(
        {"date": F.to_date("date"), "amount": plain_money_text(F.col("amount"))}
    )
    return shown.orderBy(F.col("date").desc_nulls_last(), *ties)


def filtered_summary(filtered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Record count, credits, debits and net of a filtered table."""
    amount = F.col("amount")
    credits = F.sum(F.when(amount > 0, amount))
    debits = F.sum(F.when(amount < 0, amount))
    return filtered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        as_double(zero_if_null(credits)).alias("total_credits"),
        as_double(F.abs(zero_if_null(debits))).alias("total_debits"),
        as_double(zero_if_null(F.sum(amount))).alias("net_amount"),
    )


def category_facet(tx: DataFrame) -> DataFrame:
    """Choices for the category filter: "All", then the labels in order."""
    labels = tx.filter(F.col("category").isNotNull()).select(
        F.col("category").alias("choice"), F.lit(False).alias("is_all")
    )
    everything = tx.sparkSession.range(1).select(
        F.lit(ALL).alias("choice"), F.lit(True).alias("is_all")
    )
    return labels.distinct().unionByName(everything).orderBy(F.desc("is_all"), "choice")
