"""Ready transaction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_spark.functions.parsing import to_moment


def load_transactions(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Read a transaction table from Parquet, CSV, JSON, ORC or a catalog table.

    Text formats need a schema: inferring one would read the data twice. For
    ``fmt="table"`` the path is the table name.
    """
    if fmt == "table":
        return accept_table(spark.read.table(path))
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    for name, value in options.items():
        reader = reader.option(name, value)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError(f"a schema is required to read {fmt}")
    return accept_table(reader.load(path))


def accept_table(df: DataFrame) -> DataFrame:
    """Any transaction table with its date column as TIMESTAMP_NTZ.

    Rows are not sorted here: the operators that depend on order sort by
    ``date, statement_id, seq`` themselves.
    """
    if "date" not in df.columns:
        return df
    return df.withColumn("date", to_moment(F.col("date"), df.schema["date"].dataType))


def by_date(df: DataFrame) -> DataFrame:
    """Transactions in date order, missing dates last; for output only."""
    ties = [c for c in ("statement_id", "seq") if c in df.columns]
    return df.orderBy(F.col("date").asc_nulls_last(), *ties)


def write_by_month(tx: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Store a normalised table by month, its files sorted by category and date.

    A filter on the month reads its folders only, and one on category or date
    skips files and row groups by their bounds. Rows are dealt by ranges of month,
    category and date, so a month that holds most of the table is still written by
    many tasks. Rows without a date share one folder, dealt by category.
    """
    order = ["year_month", "category", "date"]
    placed = tx.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.mode(mode).partitionBy("year_month").parquet(folder)


def read_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """A table that ``write_by_month`` stored."""
    stored = spark.read.parquet(folder)
    if stored.schema["year_month"].dataType != T.StringType():
        raise ValueError("months must be text; check partition column type inference")
    return stored
