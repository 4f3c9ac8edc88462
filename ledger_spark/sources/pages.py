"""Statement text from page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.text import clean_text


def assemble_pages(pages: DataFrame) -> DataFrame:
    """One text per statement: pages in order, each with a blank line.

    ``(statement_id, page_num)`` identifies a page. A statement's text is one
    value and has to fit a row.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text")))
    )
    text = F.array_join(
        F.transform(ordered, lambda p: F.concat(p["text"], F.lit("\n\n"))), ""
    )
    return pages.groupBy("statement_id").agg(text.alias("text"))


def clean_statements(texts: DataFrame, column: str = "text") -> DataFrame:
    """Statement texts with page markers, white space and digits repaired."""
    return texts.withColumn(column, clean_text(F.col(column)))
