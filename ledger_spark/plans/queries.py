"""Named queries over a folder of tables; each has an SQL twin in ``oracle``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.functions.parsing import as_double
from ledger_spark.functions.render import comma_list, item_lines, money_lines, record_lines
from ledger_spark.operators import (
    balance,
    categories,
    explore,
    monthly,
    patterns,
    score,
    summary,
)
from ledger_spark.operators.normalize import amount_counts, normalize, rejected_amounts
from ledger_spark.plans import narrative, reports, requests
from ledger_spark.sources import pages, replies, samples, tables
from ledger_spark.staging import new_path

ACCOUNT = ("account_id",)

# Arguments of the explorer queries.
EXPLORE = {
    "start": dt.date(1996, 1, 1),
    "end": dt.date(1997, 6, 30),
    "category": "1-URGENT",
    "type": "debit",
    "term": "cust 1",
}

# Neutral wording for requests and templates; users pass their own.
EXTRACTION_TASK = "Give one record per booking as JSON. Columns: "
ADVICE_ROLE = "You explain account figures."
ADVICE_TASK = "Reply as JSON."
REFUSED = narrative.Template(("first tip", "second tip"), "advice after a refusal")
FAILED = narrative.Template(("only tip",), "advice after a failure", with_savings_rate=False)

REPORT_TABLES = (
    reports.TRANSACTIONS,
    reports.MONTHLY_CASH_FLOW,
    reports.INCOME_VS_EXPENSES,
    reports.CATEGORY_SPENDING,
    reports.SUMMARY,
)

# Characters missing at the end of a truncated reply.
CUT = 10

Query = Callable[[SparkSession, str], DataFrame]


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return normalize(samples.order_transactions(spark, folder))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return normalize(samples.line_transactions(spark, folder))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return normalize(samples.event_transactions(spark, folder))


def events_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return normalize(samples.with_gaps(samples.event_transactions(spark, folder)))


def _over(source: Query, operator: Callable[..., DataFrame], **arguments) -> Query:
    return lambda spark, folder: operator(source(spark, folder), **arguments)


def _normalized(spark: SparkSession, folder: str) -> DataFrame:
    return _money_out(orders(spark, folder))


def _money_out(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", as_double(F.col("amount")))


def _expense_stats(tx: DataFrame, keys=()) -> DataFrame:
    stats = patterns.expense_stats(tx, keys)
    return stats.select(
        *keys,
        "rows",
        "expenses",
        as_double(F.col("expense_sum")).alias("expense_sum"),
        "expense_mean",
        "expense_stddev",
        "small_expenses",
        as_double(F.col("large_bound")).alias("large_bound"),
    )


def _large(tx: DataFrame, keys=()) -> DataFrame:
    return _money_out(patterns.large_expenses(tx, keys))


def _first_large(tx: DataFrame, keys=()) -> DataFrame:
    return _money_out(patterns.first_large_expenses(tx, keys))


def _category_map_rows(tx: DataFrame, keys=()) -> DataFrame:
    maps = patterns.category_map(tx, keys)
    return maps.select(*keys, F.explode("category_expenses").alias("category", "amount"))


def _pattern_lines(tx: DataFrame, keys=()) -> DataFrame:
    return patterns.pattern_record(tx, keys).select(
        *keys,
        money_lines(F.col("top_income_sources")).alias("income_lines"),
        money_lines(F.col("category_expenses")).alias("category_lines"),
        comma_list(F.col("recurring_expenses")).alias("recurring_list"),
        item_lines(F.col("recurring_expenses")).alias("recurring_lines"),
        record_lines(F.col("large_transactions")).alias("large_lines"),
        F.col("small_expense_count").cast("bigint").alias("small_expense_count"),
    )


def _health(tx: DataFrame, keys=()) -> DataFrame:
    return score.health_score(tx, keys)


def _health_bands(tx: DataFrame, keys=()) -> DataFrame:
    banded = score.health_bands(score.health_score(tx, keys))
    return banded.select(*keys, "health_score", "health_color", "health_message")


def _explored(spark: SparkSession, folder: str) -> DataFrame:
    return explore.filter_transactions(orders(spark, folder), **EXPLORE)


def _explore_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _money_out(_explored(spark, folder))


def _explore_display(spark: SparkSession, folder: str) -> DataFrame:
    shown = explore.display_transactions(_explored(spark, folder))
    return shown.select("seq", "date", "description", "amount", "type", "category")


def _explore_summary(spark: SparkSession, folder: str) -> DataFrame:
    return explore.filtered_summary(_explored(spark, folder))


def _page_assembly(spark: SparkSession, folder: str) -> DataFrame:
    return pages.assemble_pages(samples.conversation_pages(spark, folder))


def _clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.clean_statements(samples.document_texts(spark, folder))


def _request_parts(requests_table: DataFrame, *carried: str) -> DataFrame:
    """A request body read back part by part."""
    body = F.col("body")
    return requests_table.select(
        *carried,
        F.get_json_object(body, "$.messages[0].content").alias("system_text"),
        F.get_json_object(body, "$.messages[1].content").alias("user_text"),
        F.get_json_object(body, "$.temperature").cast("double").alias("temperature"),
        F.get_json_object(body, "$.max_tokens").cast("bigint").alias("max_tokens"),
        F.get_json_object(body, "$.response_format.type").alias("response_format"),
    )


def _extraction_requests(spark: SparkSession, folder: str) -> DataFrame:
    texts = pages.clean_statements(_page_assembly(spark, folder))
    made = requests.extraction_requests(texts, EXTRACTION_TASK + requests.field_list())
    return _request_parts(made, "statement_id")


def _advice_requests(tx: DataFrame, keys=()) -> DataFrame:
    made = requests.advice_requests(requests.account_facts(tx, keys), ADVICE_ROLE, ADVICE_TASK, keys)
    return _request_parts(made, *keys)


def _reply_out(rows: DataFrame, *extras: str) -> DataFrame:
    names = {"order_number": "order"} | {f"{e}_text": e for e in extras}
    shown = {name: F.try_element_at("extras", F.lit(key)) for name, key in names.items()}
    return _money_out(rows.withColumns(shown).drop("extras"))


def _reply_rows(cut: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        read = replies.read_replies(samples.order_replies(spark, folder, cut))
        return _reply_out(replies.reply_transactions(read))

    return query


def _dirty_replies(spark: SparkSession, folder: str) -> DataFrame:
    read = replies.read_replies(samples.order_replies(spark, folder, dirty=True))
    return _reply_out(replies.reply_transactions(read), "amount")


def _both_sinks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    path = new_path(spark, "replies")
    replies.write_replies(replies.read_replies(samples.order_replies(spark, folder, CUT)), path)
    return replies.read_written(spark, path)


def _written_responses(spark: SparkSession, folder: str) -> DataFrame:
    return _reply_out(_both_sinks(spark, folder)[0])


def _loaded(fmt: str) -> Query:
    """Orders written as files, loaded as a transaction table and normalised."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        tx = samples.order_transactions(spark, folder)
        path = new_path(spark, "transactions")
        if fmt == "csv":
            tx = tx.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
            reports.write_csv(tx, path)
            loaded = tables.load_transactions(spark, path, "csv", tx.schema)
        else:
            tx.write.parquet(path)
            loaded = tables.load_transactions(spark, path)
        return _money_out(normalize(loaded))

    return query


def _dirty_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return _money_out(normalize(samples.dirty_transactions(spark, folder)))


def _required(tx: DataFrame, keys=()) -> DataFrame:
    return reports.analyse(tx, keys, require_rows=True).monthly_cash_flow()


def _opened_balance(tx: DataFrame, keys=()) -> DataFrame:
    return balance.running_balance(tx, keys, F.col("account_id") * F.lit(10) + F.lit(0.25) if keys else F.lit(100.5))


def _explore_stored(spark: SparkSession, folder: str) -> DataFrame:
    tx, path = orders(spark, folder), new_path(spark, "by-month")
    tables.write_by_month(tx, path)
    kept = explore.filter_transactions(tables.read_by_month(spark, path), **EXPLORE, by_month=True)
    return _money_out(kept.select(tx.columns))


def _report_table(name: str, fmt: str) -> Query:
    """One table of a report set, written, verified and read back."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = new_path(spark, "reports")
        reports.write_report_set(reports.analyse(orders(spark, folder)), path, fmt)
        table = reports.read_report_set(spark, path, verify=True)[name]
        return _money_out(table) if name == reports.TRANSACTIONS else table

    return query


def _reply_status(spark: SparkSession, folder: str) -> DataFrame:
    read = replies.read_replies(samples.order_replies(spark, folder, CUT))
    return read.select(
        "statement_id", "finish_reason", "status", F.size("records").cast("bigint").alias("records")
    )


def _rejected(spark: SparkSession, folder: str) -> DataFrame:
    return _both_sinks(spark, folder)[1]


def _reply_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Replies to transactions to the monthly report, end to end."""
    read = replies.read_replies(samples.order_replies(spark, folder))
    return monthly.monthly_income_vs_expenses(normalize(replies.reply_transactions(read)))


def _narrative(template: narrative.Template) -> Callable[..., DataFrame]:
    def query(tx: DataFrame, keys=()) -> DataFrame:
        made = narrative.template_narrative(summary.summary(tx, keys), template, keys)
        return made.select(
            *keys, "summary", F.array_join("tips", "\n").alias("tips"), "custom_advice"
        )

    return query


def _facts_block(tx: DataFrame, keys=()) -> DataFrame:
    return requests.facts_block(requests.account_facts(tx, keys), keys)


def _insights(spark: SparkSession, folder: str) -> DataFrame:
    """Insight records where services answer, refuse, garble or stay silent."""
    tx = events(spark, folder)
    answer = F.to_json(
        F.struct(
            F.concat(F.lit("Account "), F.col("account_id").cast("string")).alias("summary"),
            F.array(F.lit("one"), F.lit("two")).alias("tips"),
        )
    )
    kind = F.col("account_id") % 4
    content = F.when(kind == 1, answer).otherwise(F.lit("no figures, sorry"))
    message = F.struct(F.struct(content.alias("content")).alias("message"))
    answers = (
        tx.select("account_id")
        .distinct()
        .filter(kind != 3)
        .select(
            "account_id",
            F.when(kind == 0, 429).otherwise(200).alias("status"),
            F.to_json(F.struct(F.array(message).alias("choices"))).alias("response"),
        )
    )
    facts = requests.account_facts(tx, ACCOUNT)
    # every account was asked twice; the first answers were lost
    answers = answers.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    answers = answers.withColumn("response", F.when(F.col("attempt") == 2, F.col("response")))
    record = narrative.insights(facts, REFUSED, FAILED, answers, ACCOUNT)
    return record.withColumn("tips", F.array_join("tips", "\n"))


def _csv_export(spark: SparkSession, folder: str) -> DataFrame:
    tx = events(spark, folder)
    path = new_path(spark, "csv-export")
    reports.write_csv(tx, path)
    reader = spark.read.schema(tx.schema).option("header", True)
    return _money_out(reader.option("timestampNTZFormat", reports.CSV_TIMESTAMP).csv(path))


def _report_set(spark: SparkSession, folder: str) -> DataFrame:
    """Row count and money total of every table in the exported set."""
    totals = {
        reports.TRANSACTIONS: "amount",
        reports.MONTHLY_CASH_FLOW: "net_flow",
        reports.INCOME_VS_EXPENSES: "savings",
        reports.CATEGORY_SPENDING: "amount",
        reports.SUMMARY: "net_flow",
    }
    analysis = reports.analyse(orders(spark, folder))
    paths = reports.write_report_set(analysis, new_path(spark, "reports"))
    parts = [
        spark.read.parquet(paths[name]).agg(
            F.lit(name).alias("report"),
            F.count(F.lit(1)).alias("rows"),
            as_double(F.sum(F.col(column).cast("decimal(18,2)"))).alias("total"),
        )
        for name, column in totals.items()
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def registry() -> dict[str, Query]:
    """All named queries."""
    plain: dict[str, Query] = {
        "normalized_transactions": _normalized,
        "explore_filtered": _explore_rows,
        "explore_display": _explore_display,
        "explore_summary": _explore_summary,
        "page_assembly": _page_assembly,
        "clean_statement_text": _clean_text,
        "extraction_requests": _extraction_requests,
        "parse_responses": _reply_rows(0),
        "repair_truncated": _reply_rows(CUT),
        "response_status": _reply_status,
        "rejected_responses": _rejected,
        "written_responses": _written_responses,
        "parse_dirty_responses": _dirty_replies,
        "loaded_csv": _loaded("csv"),
        "loaded_parquet": _loaded("parquet"),
        "normalized_dirty": _dirty_normalized,
        "rejected_amounts": _over(samples.dirty_transactions, rejected_amounts),
        "explore_stored": _explore_stored,
        "reports_from_responses": _reply_reports,
        "insight_records_by_account": _insights,
        "csv_export": _csv_export,
        "report_set": _report_set,
        "facet_categories": _over(orders, explore.category_facet),
        "date_bounds": _over(orders, summary.date_bounds),
        "balance_line": _over(orders, balance.balance_line),
    }
    for fmt in ("parquet", "csv"):
        for name in REPORT_TABLES:
            plain[f"report_set_{fmt}_{name.lower().replace(' ', '_')}"] = _report_table(name, fmt)
    # Name -> source and operator; each runs whole-table and per account.
    both = {
        "monthly_cash_flow": (orders, monthly.monthly_cash_flow),
        "monthly_income_vs_expenses": (orders, monthly.monthly_income_vs_expenses),
        "monthly_bars": (orders, monthly.monthly_bars),
        "savings_rate_series": (orders, monthly.savings_rate_series),
        "category_spending": (orders, categories.category_spending),
        "monthly_category_spending": (orders, categories.monthly_category_spending),
        "top_categories": (lines, categories.top_categories),
        "spending_breakdown": (lines, categories.spending_breakdown),
        "category_trend": (lines, categories.category_trend),
        "summary": (orders, summary.summary),
        "running_balance": (events, balance.running_balance),
        "running_balance_with_opening": (events, _opened_balance),
        "required_monthly_cash_flow": (events, _required),
        "amount_counts": (samples.dirty_transactions, amount_counts),
        "balance_bounds": (events, balance.balance_bounds),
        "running_balance_with_gaps": (events_with_gaps, balance.running_balance),
        "monthly_cash_flow_with_gaps": (events_with_gaps, monthly.monthly_cash_flow),
        "summary_with_gaps": (events_with_gaps, summary.summary),
        "income_by_description": (events, patterns.income_by_description),
        "top_income_sources": (events, patterns.top_income_sources),
        "expense_category_map_rows": (events, _category_map_rows),
        "expense_frequency": (events, patterns.expense_frequency),
        "recurring_expenses": (events, patterns.recurring_expenses),
        "expense_stats": (events, _expense_stats),
        "small_expense_count": (events, patterns.small_expense_count),
        "large_expenses": (events, _large),
        "first_large_expenses": (events, _first_large),
        "pattern_lines": (events, _pattern_lines),
        "health_score": (events, _health),
        "health_bands": (orders, _health_bands),
        "template_narrative": (orders, _narrative(REFUSED)),
        "template_narrative_failed": (orders, _narrative(FAILED)),
        "facts_block": (events, _facts_block),
        "advice_requests": (events, _advice_requests),
    }
    for name, (source, operator) in both.items():
        plain[name] = _over(source, operator)
        plain[f"{name}_by_account"] = _over(source, operator, keys=ACCOUNT)
    return plain
