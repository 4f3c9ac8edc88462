from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_spark.functions.parsing import to_money, to_moment
from ledger_spark.operators.normalize import amount_counts, normalize, rejected_amounts, require_transactions
from ledger_spark.schema import CATEGORIES
from ledger_spark.sources.tables import accept_table, by_date, load_transactions
from tests.conftest import row, rows_of


def test_sign_rule(table):
    cases = [
        ("debit", 5, -5),
        ("debit", -5, -5),
        ("credit", -7, 7),
        ("DEBIT", 3, 3),
        (None, -4, -4),
        ("debit", 0, 0),
        ("credit", None, None),
    ]
    tx = table([row(i, "2024-01-01", a, type=t) for i, (t, a, _) in enumerate(cases)])
    got = [r.amount for r in normalize(tx).orderBy("seq").collect()]
    assert got == [None if e is None else Decimal(e) for _, _, e in cases]


def test_category_fill_and_month_columns(table):
    tx = normalize(table([row(0, "2024-03-09", 1), row(1, None, 1, category="Food")]))
    first, second = tx.orderBy("seq").collect()
    assert (first.category, first.month, first.year, first.year_month) == ("Other", 3, 2024, "2024-03")
    assert (second.category, second.month, second.year, second.year_month) == ("Food", None, None, None)


def test_missing_columns_skip_their_rules(table):
    tx = table([row(0, "2024-03-09", 5, type="debit")]).drop("type", "category")
    only = normalize(tx).first()
    assert only.amount == 5 and "category" not in normalize(tx).columns


def test_empty_input_is_refused_on_request(table):
    empty = table([])
    assert normalize(empty).count() == 0
    refused = normalize(empty, require_rows=True)  # nothing runs yet
    for use in (refused.count, refused.collect, refused.select("seq").collect, refused.filter("amount > 0").collect):
        with pytest.raises(Exception, match="no transactions to analyse"):
            use()
    full = table([row(0, "2024-03-09", 5), row(1, None, None)])
    assert rows_of(normalize(full, require_rows=True)) == rows_of(normalize(full))
    assert rows_of(require_transactions(full).filter("seq = 7")) == []


def test_amounts_that_do_not_fit_are_listed(spark, table):
    texts = ["1" + "0" * 17, "1e400", "abc", None, "12.345", "", "nan", "-9" + "9" * 15 + ".99", "9" * 16 + ".995"]
    tx = spark.createDataFrame([("s", i, t, "2024-01-01") for i, t in enumerate(texts)], "statement_id string, seq bigint, amount string, date string")
    rejected = {r.seq: (r.amount, r.reason) for r in rejected_amounts(tx).collect()}
    assert rejected == {
        0: (texts[0], "too large"), 1: ("1e400", "too large"), 2: ("abc", "not a number"), 5: ("", "not a number"),
        6: ("nan", "not a number"), 8: (texts[8], "too large"),
    }
    counts = amount_counts(tx).first().asDict()
    assert counts == {"rows": 9, "amounts": 2, "missing": 1, "not_numbers": 3, "too_large": 3}
    assert normalize(tx).filter("amount is not null").count() == counts["amounts"]
    numbers = spark.createDataFrame([(1.5,), (1e17,), (float("nan"),), (float("inf"),), (None,)], "amount double").selectExpr("*", "date'2024-01-01' as date")
    assert amount_counts(numbers).first().asDict() == {"rows": 5, "amounts": 1, "missing": 1, "not_numbers": 1, "too_large": 2}
    assert rejected_amounts(table([row(0, None, 1), row(1, None, None)])).collect() == []


@pytest.mark.parametrize(
    "text, expected",
    [
        ("12d", None),
        ("1,234.5", None),
        (" 12 ", Decimal("12.00")),
        ("1e3", Decimal("1000.00")),
        ("nan", None),
        ("inf", None),
        ("", None),
        ("₹5", None),
        ("-3", Decimal("-3.00")),
        (None, None),
    ],
)
def test_money_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(to_money(F.col("a"))).first()[0] == expected


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.5,)], "a double")
    assert [r[0] for r in df.select(to_money(F.col("a"))).collect()] == [None, None, Decimal("2.50")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-05", dt.datetime(2024, 1, 5)),
        ("2024-1-5", dt.datetime(2024, 1, 5)),
        ("05/01/2024", None),
        ("2024-02-30", None),
        ("2024", None),
        ("2024-01", None),
        ("2024-01-05T10:00:00", dt.datetime(2024, 1, 5, 10)),
        ("bad", None),
        (None, None),
    ],
)
def test_date_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(to_moment(F.col("a"), T.StringType())).first()[0] == expected


def test_accept_table_converts_dates_and_by_date_sorts(spark):
    df = spark.createDataFrame(
        [("2024-02-01", 1), (None, 2), ("2024-01-01", 3)], "date string, seq long"
    )
    assert [r.seq for r in by_date(accept_table(df)).collect()] == [3, 1, 2]
    assert accept_table(df).schema["date"].dataType == T.TimestampNTZType()


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_load_formats(spark, table, tmp_path, fmt):
    tx = table([row(0, "2024-03-09 10:00", 5, "a", "debit", "Food"), row(1, None, None, None)])
    path = str(tmp_path / "in")
    writer = tx.write.option("header", True) if fmt == "csv" else tx.write
    writer.format(fmt).save(path)
    schema = tx.schema if fmt in ("csv", "json") else None
    loaded = load_transactions(spark, path, fmt, schema)
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, tx.collect()))


def test_text_formats_need_a_schema(spark):
    with pytest.raises(ValueError):
        load_transactions(spark, "/nowhere", "csv")


def test_load_catalog_table(spark, table):
    table([row(0, "2024-03-09", 5)]).createOrReplaceTempView("statements")
    assert load_transactions(spark, "statements", "table").count() == 1


def test_sixteen_categories():
    assert len(CATEGORIES) == len(set(CATEGORIES)) == 16
