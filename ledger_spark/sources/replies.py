"""Model replies in JSON to transaction rows, advice fields and rejects.

A reply row keeps its raw text in ``response``. ``read_replies`` adds

* ``content``       the message text of the reply envelope,
* ``finish_reason`` why the model stopped,
* ``records``       the parsed records, null when the reply is unusable,
* ``status``        ``parsed``, ``repaired`` or ``rejected``.

Every step is a column expression on one row, so the functions work on batch
and streaming tables alike and cause no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_spark.functions.parsing import to_money, to_moment
from ledger_spark.functions.text import before_last

_RECORD = "map<string,string>"
_ITEMS = "array<variant>"
_FIELDS = ("date", "description", "amount", "type", "category")
_ACCEPTED, _REJECTED = "accepted", "rejected"


def _document(text: Column) -> Column:
    """A JSON object or array as a variant; null for anything else.

    The text has to end with its bracket, which refuses text after the value
    that the JSON functions themselves would ignore.
    """
    shaped = text.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$")
    return F.when(shaped, F.try_parse_json(text))


def _records(document: Column) -> Column:
    """Records of a document: a bare array, or the list under ``transactions``.

    A document without such a list has no records; a list with an element that
    is no object gives null.
    """
    items = F.coalesce(
        F.try_variant_get(document, "$", _ITEMS),
        F.try_variant_get(document, "$.transactions", _ITEMS),
        F.array().cast(_ITEMS),
    )
    records = F.transform(items, lambda v: F.try_variant_get(v, "$", _RECORD))
    wrong = F.exists(items, lambda v: ~F.is_variant_null(v) & F.try_variant_get(v, "$", _RECORD).isNull())
    return F.when(document.isNotNull() & ~wrong, records)


def close_truncated(text: Column) -> Column:
    """Cut a truncated reply after its last complete record and close it.

    Null when the text holds no closing brace at all.
    """
    kept = F.when(
        F.contains(text, F.lit("},")), F.concat(before_last(text, "},"), F.lit("}"))
    ).when(F.contains(text, F.lit("}")), F.concat(before_last(text, "}"), F.lit("}")))
    ending = F.when(F.contains(text, F.lit("transactions")), F.lit("]\n}")).otherwise(F.lit("]"))
    return F.concat(kept, ending)


def read_replies(replies: DataFrame, response: str = "response") -> DataFrame:
    """Add content, finish_reason, records and status to a table of replies.

    The reply and its content are parsed once each; everything else is taken from
    the parsed form. Only content that fails and was cut off goes through repair.
    A reply that is no JSON has no content and is rejected.
    """
    parsed = replies.withColumn("__reply", F.try_parse_json(F.col(response)))
    reply = F.col("__reply")
    # A valid reply without content counts as an empty object.
    content = F.coalesce(
        F.try_variant_get(reply, "$.choices[0].message.content", "string"), F.when(reply.isNotNull(), F.lit("{}"))
    )
    reason = F.try_variant_get(reply, "$.choices[0].finish_reason", "string")
    df = parsed.withColumns({"content": content, "finish_reason": reason}).drop("__reply")
    df = df.withColumn("__whole", _document(F.col("content")))
    cut_off = F.col("__whole").isNull() & F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    df = df.withColumn("__mended", F.when(cut_off, _document(close_truncated(F.col("content")))))
    df = df.withColumn("__document", F.coalesce("__whole", "__mended"))
    df = df.withColumn("records", _records(F.col("__document")))
    how = F.when(F.col("__whole").isNotNull(), F.lit("parsed")).otherwise(F.lit("repaired"))
    status = F.when(F.col("records").isNull(), F.lit("rejected")).otherwise(how)
    return df.withColumn("status", status).drop("__whole", "__mended", "__document")


def _lower_keys(record: Column) -> Column:
    """The record with its keys in lower case; the last of equal keys counts."""
    entries = F.map_entries(record)
    lowered = F.transform(F.map_keys(record), lambda k: F.lower(k))
    names = F.array_distinct(lowered)
    pairs = F.transform(
        names,
        lambda n: F.struct(
            n.alias("key"),
            F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"].alias(
                "value"
            ),
        ),
    )
    distinct = F.size(names) == F.size(record)
    return F.when(distinct, F.map_from_arrays(lowered, F.map_values(record))).otherwise(F.map_from_entries(pairs))


def _too_large(value: Column) -> Column:
    number = value.try_cast("double")
    return F.coalesce(to_money(value).isNull() & number.isNotNull() & ~F.isnan(number), F.lit(False))


def _carried(read: DataFrame) -> list[str]:
    return [c for c in ("statement_id", "account_id") if c in read.columns]


def _transaction_columns(record: Column) -> list[Column]:
    return [
        F.col("seq").cast("bigint").alias("seq"),
        to_moment(record["date"], T.StringType()).alias("date"),
        record["description"].alias("description"),
        to_money(record["amount"]).alias("amount"),
        record["type"].alias("type"),
        record["category"].alias("category"),
        F.map_filter(record, lambda k, v: ~k.isin(*_FIELDS) | ((k == "amount") & _too_large(v))).alias("extras"),
    ]


def reply_transactions(read: DataFrame) -> DataFrame:
    """Transaction rows of the usable replies, numbered within their reply.

    Field names are lower-cased before values are converted, so ``Date`` and
    ``Amount`` are converted too. A number too large for an amount stays in
    ``extras`` as text.
    """
    carried = _carried(read)
    # The outer form, and a filter on its output: a filter on ``records`` itself
    # (also the one that the inner form implies) would be pushed below the
    # parsing and repeat it.
    rows = read.select(*carried, F.posexplode_outer("records").alias("seq", "record"))
    rows = rows.filter(F.col("seq").isNotNull())
    rows = rows.withColumn("record", _lower_keys(F.col("record")))
    return rows.select(*carried, *_transaction_columns(F.col("record")))


def rejected_replies(read: DataFrame, response: str = "response") -> DataFrame:
    """Replies that stay unusable after repair, with their raw text."""
    carried = _carried(read)
    # Exploded rather than filtered on ``status``, for the same reason as above.
    raw = F.explode_outer(F.when(F.col("status") == "rejected", F.array(F.struct(response))))
    kept = read.select(*carried, raw.alias("__raw")).filter(F.col("__raw").isNotNull())
    return kept.select(*carried, f"__raw.{response}")


def write_replies(
    read: DataFrame,
    folder: str,
    response: str = "response",
    mode: str = "errorifexists",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write transactions and rejects in one pass, below ``kind=accepted`` and ``kind=rejected``.

    ``prepare`` may add to the transaction columns, as ``normalize`` does. Replies
    without any record leave no row.
    """
    carried = _carried(read)
    rows = read.select(*carried, "status", response, F.posexplode_outer("records").alias("seq", "record"))
    kind = F.when(F.col("seq").isNotNull(), F.lit(_ACCEPTED)).when(F.col("status") == "rejected", F.lit(_REJECTED))
    rows = rows.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    rows = rows.withColumn("record", _lower_keys(F.col("record")))
    raw = F.when(F.col("kind") == _REJECTED, F.col(response)).alias(response)
    rows = rows.select("kind", raw, *carried, *_transaction_columns(F.col("record")))
    rows = prepare(rows) if prepare else rows
    rows.write.mode(mode).partitionBy("kind").parquet(folder)


def read_written(spark: SparkSession, folder: str, response: str = "response") -> tuple[DataFrame, DataFrame]:
    """Transactions and rejects that ``write_replies`` left below ``folder``; each reads its own files only."""
    written = spark.read.parquet(folder)
    accepted = written.filter(F.col("kind") == _ACCEPTED).drop("kind", response)
    rejected = written.filter(F.col("kind") == _REJECTED).select(*_carried(written), response)
    return accepted, rejected


def decode_advice(content: Column) -> Column:
    """Advice reply text as (summary, tips, custom_advice); null when not JSON.

    Missing parts become empty text or an empty list.
    """

    def parts(document: Column) -> Column:
        text = lambda path: F.coalesce(F.try_variant_get(document, path, "string"), F.lit(""))
        tips = F.coalesce(F.try_variant_get(document, "$.tips", "array<string>"), F.array().cast("array<string>"))
        whole = F.struct(
            text("$.summary").alias("summary"), tips.alias("tips"), text("$.custom_advice").alias("custom_advice")
        )
        return F.when(document.isNotNull(), whole)

    return F.transform(F.array(_document(content)), parts)[0]
