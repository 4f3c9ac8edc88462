"""Running balance and the data of its line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.parsing import as_double, zero_if_null
from ledger_spark.keyed import ROWS_PER_TASK
from ledger_spark.operators.running import ROWS_PER_BLOCK, running_sum


def running_balance(
    tx: DataFrame,
    keys: Sequence[str] = (),
    opening: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Cumulative sum of amounts by date, starting from ``opening`` (default 0).

    A row without an amount has no balance and later rows continue; rows
    without a date come last; rows of one moment go by ``statement_id, seq``.
    """
    columns = list(dict.fromkeys([*keys, "statement_id", "seq", "date"]))
    rows = tx.select(*columns, "amount")
    if opening is not None:
        rows = tx.select(*columns, "amount", opening.cast("decimal(28,2)").alias("__opening"))
    order = [F.col("date").asc_nulls_last(), F.col("statement_id").asc(), F.col("seq").asc()]
    value = zero_if_null(F.col("amount"))
    summed = running_sum(rows, value, order, "__running", keys, rows_per_task, rows_per_block)
    balance = F.col("__running")
    if opening is not None:
        balance = balance + F.col("__opening")
    shown = F.when(F.col("amount").isNotNull(), as_double(balance))
    return summed.select(*columns, shown.alias("running_balance"))


def balance_line(
    tx: DataFrame, keys: Sequence[str] = (), opening: Column | None = None
) -> DataFrame:
    """The two columns of the balance line, in date order for a whole table.

    The running sum already leaves a whole table in blocks whose number is their
    place in the order, each sorted in a partition of that number, so partitions
    and files come in date order without another sort.
    """
    return running_balance(tx, keys, opening).select(*keys, "date", "running_balance")


def balance_bounds(tx: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """End points of the zero reference line under the balance line."""
    return tx.groupBy(*keys).agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.lit(0.0).alias("zero"),
    )
