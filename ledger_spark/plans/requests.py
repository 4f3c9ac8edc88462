"""Request tables for a model job that runs outside Spark.

The jobs meet at files only: these tables are written out, and the replies come
back as another table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.render import (
    comma_list,
    money_lines,
    money_text,
    percent_text,
    record_lines,
)
from ledger_spark.keyed import ROWS_PER_TASK, join_on_keys
from ledger_spark.operators.patterns import pattern_record
from ledger_spark.operators.rollup import base_cells
from ledger_spark.operators.score import score_expression
from ledger_spark.operators.summary import profile
from ledger_spark.schema import CATEGORIES, TRANSACTIONS
from ledger_spark.staging import stage

# Sampling temperature and reply length of the two requests.
EXTRACTION_SETTINGS = (0.1, 8000)
ADVICE_SETTINGS = (0.7, 2000)

# Columns of a transaction that a reply has to give.
REPLY_FIELDS = ("date", "description", "amount", "type", "category")


def _body(system: Column, user: Column, settings: tuple[float, int]) -> Column:
    temperature, length = settings

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(
        F.struct(
            F.array(message("system", system), message("user", user)).alias("messages"),
            F.lit(temperature).alias("temperature"),
            F.lit(length).alias("max_tokens"),
            F.struct(F.lit("json_object").alias("type")).alias("response_format"),
        )
    )


def field_list() -> str:
    """The columns that a reply's records should have, and the labels of a category."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in TRANSACTIONS.fields if f.name in REPLY_FIELDS]
    return "; ".join(fields) + "; labels " + "/".join(CATEGORIES)


def extraction_requests(texts: DataFrame, system: str, user: str = "") -> DataFrame:
    """One extraction request per statement, as a JSON body.

    The caller words the task; ``field_list`` describes the expected records.
    """
    prompt = F.concat(F.lit(user), F.col("text"))
    return texts.select(
        "statement_id", _body(F.lit(system), prompt, EXTRACTION_SETTINGS).alias("body")
    )


# Parts of the facts text in order: heading and the record's columns shown below it.
FACTS = (
    ("Score", (("points", "health_score"),)),
    ("Money", (("in", "total_income"), ("out", "total_expenses"), ("left", "net_flow"), ("saved", "avg_savings_rate"))),
    ("Most spent on", (("category", "top_expense_category"), ("amount", "top_expense_amount"))),
    ("By category", (("", "category_expenses"),)),
    ("From", (("", "top_income_sources"),)),
    ("Again and again", (("", "recurring_expenses"),)),
    ("Out of line", (("", "large_transactions"), ("below the small bound", "small_expense_count"))),
    ("Days", (("", "date_range"),)),
)
_MONEY_COLUMNS = ("total_income", "total_expenses", "net_flow", "top_expense_amount")
_LISTS = {
    "category_expenses": money_lines,
    "top_income_sources": money_lines,
    "recurring_expenses": comma_list,
    "large_transactions": record_lines,
}


def facts_text(record: DataFrame) -> Column:
    """Figures and patterns of one account as text, laid out by ``FACTS``.

    ``record`` has the columns of ``account_facts``.
    """

    def shown(label: str, column: str) -> Column:
        value = F.col(column)
        if column in _LISTS:
            return _LISTS[column](value)
        text = percent_text(value) if column == "avg_savings_rate" else value.cast("string")
        text = F.coalesce(money_text(value) if column in _MONEY_COLUMNS else text, F.lit("n/a"))
        return F.concat(F.lit(f"{label}: "), text) if label else text

    parts = []
    for heading, columns in FACTS:
        parts += [F.lit(f"[{heading}]"), *(shown(label, column) for label, column in columns)]
    return F.concat_ws("\n", *parts)


def account_facts(
    tx: DataFrame,
    keys: Sequence[str] = (),
    cells: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Summary, patterns and health score side by side, one row per key.

    The rollup is staged once and serves the summary, the expense statistics and
    the category map; the score takes its counts from the pattern record. In all
    the transactions are read three times.
    """
    if cells is None:
        cells = stage(base_cells(tx, keys, moments=True), "cells")
    profiles = profile(keys=keys, cells=cells)
    patterns = pattern_record(tx, keys, cells, rows_per_task)
    if keys:
        facts = join_on_keys(profiles, patterns, keys)
    else:
        facts = profiles.crossJoin(F.broadcast(patterns))
    score = score_expression(
        F.col("net_flow"),
        F.col("avg_savings_rate"),
        F.size("top_income_sources"),
        F.col("expense_categories"),
        F.size("large_transactions"),
        F.col("small_expense_count"),
    )
    return facts.withColumn("health_score", score)


def facts_block(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The facts text per key."""
    return facts.select(*keys, facts_text(facts).alias("facts"))


def advice_requests(
    facts: DataFrame, system: str, task: str, keys: Sequence[str] = ()
) -> DataFrame:
    """One advice request per key, as a JSON body; the caller words it."""
    prompt = F.concat(facts_text(facts), F.lit("\n\n"), F.lit(task))
    return facts.select(*keys, _body(F.lit(system), prompt, ADVICE_SETTINGS).alias("body"))
