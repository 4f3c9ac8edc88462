"""Report sets from one table, and their export."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_spark.operators import balance, categories, monthly, patterns, score, summary
from ledger_spark.operators.normalize import require_transactions
from ledger_spark.operators.rollup import base_cells
from ledger_spark.plans import narrative, requests
from ledger_spark.staging import stage

# The tables of the exported set.
TRANSACTIONS = "Transactions"
MONTHLY_CASH_FLOW = "Monthly Cash Flow"
INCOME_VS_EXPENSES = "Income vs Expenses"
CATEGORY_SPENDING = "Category Spending"
SUMMARY = "Summary"

CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


@dataclass
class Analysis:
    """The reports on one normalised table.

    They all come from cells that were rolled up and staged once, so each
    report is a small plan. Nothing else is computed until it is asked for.
    """

    transactions: DataFrame
    keys: Sequence[str]
    cells: DataFrame

    def monthly_cash_flow(self) -> DataFrame:
        return monthly.monthly_cash_flow(keys=self.keys, cells=self.cells)

    def monthly_income_vs_expenses(self) -> DataFrame:
        return monthly.monthly_income_vs_expenses(keys=self.keys, cells=self.cells)

    def monthly_bars(self) -> DataFrame:
        return monthly.monthly_bars(keys=self.keys, cells=self.cells)

    def savings_rate_series(self) -> DataFrame:
        return monthly.savings_rate_series(keys=self.keys, cells=self.cells)

    def category_spending(self) -> DataFrame:
        return categories.category_spending(keys=self.keys, cells=self.cells)

    def monthly_category_spending(self) -> DataFrame:
        return categories.monthly_category_spending(keys=self.keys, cells=self.cells)

    def spending_breakdown(self) -> DataFrame:
        return categories.spending_breakdown(keys=self.keys, cells=self.cells)

    def category_trend(self, n: int = 5) -> DataFrame:
        return categories.category_trend(keys=self.keys, n=n, cells=self.cells)

    def summary(self) -> DataFrame:
        return summary.summary(keys=self.keys, cells=self.cells)

    def running_balance(self, opening: Column | None = None) -> DataFrame:
        return balance.running_balance(self.transactions, self.keys, opening)

    def balance_line(self, opening: Column | None = None) -> DataFrame:
        return balance.balance_line(self.transactions, self.keys, opening)

    def balance_bounds(self) -> DataFrame:
        return balance.balance_bounds(self.transactions, self.keys)

    def expense_stats(self) -> DataFrame:
        return patterns.expense_stats(keys=self.keys, cells=self.cells)

    def large_expenses(self) -> DataFrame:
        return patterns.large_expenses(self.transactions, self.keys, self.expense_stats())

    def patterns(self) -> DataFrame:
        return patterns.pattern_record(self.transactions, self.keys, self.cells)

    def health_score(self) -> DataFrame:
        return score.health_score(self.transactions, self.keys, self.cells)

    def health_bands(self) -> DataFrame:
        return score.health_bands(self.health_score())

    def facts(self) -> DataFrame:
        """Summary, patterns and score side by side."""
        return requests.account_facts(self.transactions, self.keys, self.cells)

    def insights(
        self, refused: narrative.Template, failed: narrative.Template, answers: DataFrame | None = None
    ) -> DataFrame:
        return narrative.insights(self.facts(), refused, failed, answers, self.keys)


def analyse(
    transactions: DataFrame, keys: Sequence[str] = (), require_rows: bool = False
) -> Analysis:
    """Roll up a normalised table once and offer all its reports.

    With ``require_rows`` every report of a table without rows fails when it is
    read or written; without it such reports are empty.
    """
    cells = stage(base_cells(transactions, keys, moments=True), "cells")
    if require_rows:
        cells, transactions = require_transactions(cells), require_transactions(transactions)
    return Analysis(transactions, tuple(keys), cells)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header line, one per partition; quotes are doubled."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    writer.option("timestampNTZFormat", CSV_TIMESTAMP).csv(path)


def report_tables(analysis: Analysis) -> dict[str, DataFrame]:
    """The tables of the exported set, by name."""
    return {
        TRANSACTIONS: analysis.transactions,
        MONTHLY_CASH_FLOW: analysis.monthly_cash_flow(),
        INCOME_VS_EXPENSES: analysis.monthly_income_vs_expenses(),
        CATEGORY_SPENDING: analysis.category_spending(),
        SUMMARY: analysis.summary(),
    }


def _checksum(table: DataFrame) -> tuple[int, str]:
    """Number of rows and the sum of their hashes, which no order or partitioning changes."""
    hashes = F.xxhash64(*table.columns).cast("decimal(38,0)")
    rows, total = table.agg(F.count(F.lit(1)), F.sum(hashes)).first()
    return rows, str(total or 0)


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt != "csv":
        return reader.format(fmt).load(path)
    reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.option("timestampNTZFormat", CSV_TIMESTAMP).csv(path)


_MANIFEST = "manifest"
_ENTRY = (
    "version string, written_at timestamp, name string, path string, format string, schema string, "
    "rows bigint, checksum string"
)


def _latest(spark: SparkSession, folder: str) -> list[Row]:
    """Entries of the last complete set; none if there is no set."""
    try:
        manifest = spark.read.schema(_ENTRY).parquet(f"{folder}/{_MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    # one row per set
    sets = manifest.groupBy("version").agg(F.max("written_at").alias("written_at"))
    last = sets.orderBy(F.desc("written_at"), "version").first()
    return manifest.filter(F.col("version") == last["version"]).collect() if last else []


def write_report_set(
    analysis: Analysis, folder: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> dict[str, str]:
    """Write the tables of the set as one unit; returns the path of each table.

    The tables go to a new folder of their own. When all of them are written, and
    read back for their row counts and checksums, one file that names them is
    added to the manifest. Readers go by the manifest, so they see a whole set or
    the one before, also when a job dies half-way or two run at once. ``mode``
    "overwrite" makes the new set the current one; the files of earlier sets stay
    until their folder is deleted.
    """
    folder = folder.rstrip("/")
    spark = analysis.transactions.sparkSession
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode is errorifexists or overwrite")
    if mode == "errorifexists" and _latest(spark, folder):
        raise FileExistsError(f"{folder} holds a report set")
    version = uuid.uuid4().hex
    entries, paths = [], {}
    for name, table in report_tables(analysis).items():
        path = f"{folder}/set-{version}/{name.lower().replace(' ', '_')}"
        if fmt == "csv":
            write_csv(table, path)
        else:
            table.write.format(fmt).save(path)
        rows, checksum = _checksum(_read(spark, path, fmt, table.schema))
        entries.append((version, None, name, path, fmt, table.schema.json(), rows, checksum))
        paths[name] = path
    manifest = spark.createDataFrame(entries, _ENTRY).withColumn("written_at", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{folder}/{_MANIFEST}")
    return paths


def read_report_set(spark: SparkSession, folder: str, verify: bool = False) -> dict[str, DataFrame]:
    """The tables of the last complete set, by name.

    ``verify`` reads every table and compares rows and checksums with the manifest.
    """
    folder = folder.rstrip("/")
    entries = _latest(spark, folder)
    if not entries:
        raise FileNotFoundError(f"{folder} holds no report set")
    tables = {}
    for entry in entries:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        table = _read(spark, entry["path"], entry["format"], schema)
        if verify and _checksum(table) != (entry["rows"], entry["checksum"]):
            raise ValueError(f"{entry['name']} differs from its manifest")
        tables[entry["name"]] = table
    return tables
