"""Transaction tables derived from order, line-item and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.functions.parsing import to_money
from ledger_spark.schema import MONEY


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def order_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One transaction per order; some types and categories are missing."""
    status = F.col("o_orderstatus")
    price = to_money(F.col("o_totalprice"))
    return _read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("statement_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("date"),
        F.concat(F.lit("CUST "), F.col("o_custkey").cast("string")).alias("description"),
        F.when(status == "P", -price).otherwise(price).alias("amount"),
        F.when(status == "O", "credit").when(status == "F", "debit").alias("type"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("category"),
    )


def line_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One transaction per line item, named by its part; has no row number."""
    lines = _read(spark, folder, "lineitem")
    parts = _read(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").cast("string").alias("statement_id"),
        F.col("l_suppkey").alias("account_id"),
        F.col("l_shipdate").alias("date"),
        F.col("p_name").alias("description"),
        to_money(F.col("l_extendedprice")).alias("amount"),
        F.when(F.col("l_returnflag") == "A", "credit").otherwise("debit").alias("type"),
        F.col("p_brand").alias("category"),
    )


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One transaction per event, with times within the day."""
    label = F.get_json_object("props", "$.k")
    return _read(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("statement_id"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("account_id"),
        F.col("ts").alias("date"),
        F.concat_ws(" ", "event_type", label).alias("description"),
        (to_money(F.col("value")) * F.lit(20)).cast(MONEY).alias("amount"),
        F.when(F.col("event_type") == "purchase", "credit").otherwise("debit").alias("type"),
        F.col("event_type").alias("category"),
    )


def with_gaps(tx: DataFrame) -> DataFrame:
    """The rows of ``tx`` with every 7th date, 11th amount and 13th description missing."""
    every = {"date": 7, "amount": 11, "description": 13}
    return tx.withColumns({c: F.when(F.col("seq") % n != 0, F.col(c)) for c, n in every.items()})


def dirty_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Event transactions as text, with dates and amounts that cannot be read here and there."""
    tx = event_transactions(spark, folder)

    def instead(column: Column, every: int, values: dict[int, str | None]) -> Column:
        for rest, text in values.items():
            column = F.when(F.col("seq") % every == rest, F.lit(text)).otherwise(column)
        return column

    amounts = {0: "abc", 1: "1" + "0" * 17, 2: "", 3: None, 4: " -12.5 ", 5: "1e400", 6: "nan"}
    dates = {0: "2024", 1: "05/01/2024", 2: "soon", 3: None, 4: "2024-01-05T06:07:08", 5: "2024-02-30"}
    return tx.withColumns(
        {
            "amount": instead(F.col("amount").cast("string"), 17, amounts),
            "date": instead(F.date_format("date", "yyyy-MM-dd"), 13, dates),
        }
    )


def conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as the pages of a statement."""
    return _read(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("statement_id"),
        F.col("turn").alias("page_num"),
        "text",
    )


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as statement texts, each headed by a page marker."""
    marker = F.concat(
        F.lit("Page "),
        (F.col("doc_id") % 9 + 1).cast("string"),
        F.lit(" of 9\n\tl"),
        (F.col("doc_id") % 7).cast("string"),
        F.lit(" O"),
        (F.col("doc_id") % 5).cast("string"),
        F.lit("  "),
    )
    return _read(spark, folder, "documents").select(
        "doc_id", F.concat(marker, F.coalesce("text", F.lit(""))).alias("text")
    )


def order_replies(spark: SparkSession, folder: str, cut: int = 0, dirty: bool = False) -> DataFrame:
    """Model replies that hold an account's orders as JSON records.

    A reply covers one account and a run of 1,000 order numbers, so its size is
    bounded. Even replies wrap the list in an object, odd ones are bare arrays.
    With ``cut`` the last characters are missing and the model reports that it
    ran out of length. With ``dirty`` some dates and amounts cannot be read.
    """
    tx = order_transactions(spark, folder)
    date, amount = F.date_format("date", "yyyy-MM-dd"), F.col("amount")
    if dirty:
        rest = F.col("seq") % 11
        date = F.when(rest == 0, "2024").when(rest == 1, "5 May 2024").otherwise(date)
        amount = amount.cast("string")
        amount = F.when(rest == 1, "abc").when(rest == 2, "3" + "0" * 20).when(rest == 3, " 7.125 ").otherwise(amount)
    record = F.struct(
        date.alias("Date"),
        F.col("description"),
        amount.alias("Amount"),
        F.col("type"),
        F.col("category"),
        F.col("seq").cast("string").alias("order"),
    )
    run = F.floor(F.col("seq") / 1000).cast("bigint").alias("run")
    records = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", record.alias("record")))),
        lambda e: e["record"],
    )
    grouped = tx.groupBy("account_id", run).agg(records.alias("records"))
    even = F.col("run") % 2 == 0
    whole = F.when(
        even, F.to_json(F.struct(F.col("records").alias("transactions")))
    ).otherwise(F.to_json("records"))
    content = F.left(whole, F.length(whole) - F.lit(cut)) if cut else whole
    reason = F.lit("length" if cut else "stop")
    message = F.struct(content.alias("content"))
    choice = F.struct(message.alias("message"), reason.alias("finish_reason"))
    return grouped.select(
        F.concat_ws("-", "account_id", "run").alias("statement_id"),
        "account_id",
        F.to_json(F.struct(F.array(choice).alias("choices"))).alias("response"),
    )
