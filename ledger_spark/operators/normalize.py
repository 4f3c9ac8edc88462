"""Transactions as the reports expect them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_spark.functions.parsing import signed, to_money, to_moment
from ledger_spark.schema import UNCATEGORISED


NO_TRANSACTIONS = "no transactions to analyse"


def require_transactions(tx: DataFrame, message: str = NO_TRANSACTIONS) -> DataFrame:
    """The same rows; whatever reads them fails with ``message`` if there are none.

    The test is part of the plan: a second branch of a union counts the rows, at
    most one of them, and raises instead of giving a row. So it needs no job of
    its own and also holds for tables that are filled later.
    """
    found = tx.limit(1).agg(F.count(F.lit(1)).alias("__found"))

    def stop(kind: T.DataType, usually: bool | None) -> Column:
        refusal = F.raise_error(F.lit(message)).cast(kind)
        return F.when(F.col("__found") == 0, refusal).otherwise(F.lit(usually).cast(kind))

    # the columns raise as well, so that no filter on them removes the branch
    values = [stop(field.dataType, None).alias(field.name) for field in tx.schema]
    return tx.union(found.filter(stop(T.BooleanType(), False)).select(*values))


def normalize(tx: DataFrame, require_rows: bool = False) -> DataFrame:
    """Numeric signed amounts, filled categories, and month columns.

    Columns that the table lacks are left out, and so are the rules that need
    them. The result is a projection of ``tx``: nothing is shuffled or sorted.
    With ``require_rows`` a table without rows is refused when it is read.
    Amounts that are no number, or too large for one, become null;
    ``rejected_amounts`` lists them.
    """
    if require_rows:
        tx = require_transactions(tx)
    amount = to_money(F.col("amount"))
    if "type" in tx.columns:
        amount = signed(amount, F.col("type"))
    date = to_moment(F.col("date"), tx.schema["date"].dataType)
    changed = {"date": date, "amount": amount}
    if "category" in tx.columns:
        changed["category"] = F.coalesce("category", F.lit(UNCATEGORISED))
    return tx.withColumns(changed).withColumns(
        {
            "month": F.month("date"),
            "year": F.year("date"),
            "year_month": F.date_format("date", "yyyy-MM"),
        }
    )


NOT_A_NUMBER, TOO_LARGE = "not a number", "too large"


def _reason(raw: Column) -> Column:
    """Why a value gives no amount; null for a missing value and for a good one."""
    number = raw.try_cast("double")
    unusable = raw.isNotNull() & to_money(raw).isNull()
    return F.when(unusable & (number.isNull() | F.isnan(number)), F.lit(NOT_A_NUMBER)).when(unusable, F.lit(TOO_LARGE))


def rejected_amounts(tx: DataFrame) -> DataFrame:
    """Row id, raw text and reason of every value of ``amount`` that ``normalize`` makes null.

    ``tx`` is the table before normalising. Missing amounts are no rejects.
    """
    row_id = [c for c in ("statement_id", "seq", "account_id") if c in tx.columns]
    raw = F.col("amount")
    rows = tx.select(*row_id, raw.cast("string").alias("amount"), _reason(raw).alias("reason"))
    return rows.filter(F.col("reason").isNotNull())


def amount_counts(tx: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the table before normalising, by what becomes of their amount.

    ``rows`` is the sum of ``amounts``, ``missing``, ``not_numbers`` and ``too_large``.
    """
    raw, reason = F.col("amount"), _reason(F.col("amount"))
    return tx.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(to_money(raw)).alias("amounts"),
        F.count_if(raw.isNull()).alias("missing"),
        F.count_if(reason == NOT_A_NUMBER).alias("not_numbers"),
        F.count_if(reason == TOO_LARGE).alias("too_large"),
    )
