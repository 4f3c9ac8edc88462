"""Bank-statement analytics on Spark, for one account or for many at once."""

from ledger_spark.operators.normalize import normalize, rejected_amounts, require_transactions
from ledger_spark.plans.reports import Analysis, analyse, read_report_set, write_csv, write_report_set
from ledger_spark.session import build_session
from ledger_spark.sources.tables import accept_table, load_transactions, read_by_month, write_by_month

__all__ = [
    "Analysis",
    "accept_table",
    "analyse",
    "build_session",
    "load_transactions",
    "normalize",
    "read_by_month",
    "read_report_set",
    "rejected_amounts",
    "require_transactions",
    "write_by_month",
    "write_csv",
    "write_report_set",
]
