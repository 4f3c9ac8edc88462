"""Table layouts and fixed value domains shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# The category labels a statement row may carry.
CATEGORIES = (
    "Income",
    "Housing",
    "Utilities",
    "Food",
    "Transportation",
    "Entertainment",
    "Shopping",
    "Health",
    "Education",
    "Personal",
    "Travel",
    "Insurance",
    "Investments",
    "Transfers",
    "Fees",
    "Other",
)

# Fixed value: the label that replaces a missing category.
UNCATEGORISED = "Other"

# The two transaction types that carry a sign rule.
DEBIT = "debit"
CREDIT = "credit"

TRANSACTIONS = T.StructType(
    [
        T.StructField("statement_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("type", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("statement_id", T.StringType()),
        T.StructField("page_num", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

REPLIES = T.StructType(
    [
        T.StructField("statement_id", T.StringType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("response", T.StringType()),
    ]
)
