from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import balance
from ledger_spark.operators.normalize import normalize
from tests.conftest import random_rows, row, rows_of

ACCOUNT = ["account_id"]


def brute_balances(rows, keyed):
    """Balances by walking through the sorted rows."""
    ordered = sorted(
        rows, key=lambda r: (r.date is None, r.date or dt.datetime.min, r.statement_id, r.seq)
    )
    totals: dict = {}
    out = {}
    for r in ordered:
        key = r.account_id if keyed else None
        if r.amount is not None:
            totals[key] = totals.get(key, Decimal(0)) + r.amount
        out[r.seq] = None if r.amount is None else float(totals[key])
    return out


def balances(df):
    return {r.seq: r.running_balance for r in df.collect()}


@pytest.mark.parametrize("rows_per_block", [1, 7, 60, 1_000_000])
def test_whole_table_equals_brute_force(table, rows_per_block):
    tx = normalize(table(random_rows(1, 300)))
    got = balances(balance.running_balance(tx, rows_per_block=rows_per_block))
    assert got == brute_balances(tx.collect(), keyed=False)


@pytest.mark.parametrize("rows_per_task", [5, 40, 100, 5_000_000])
def test_per_account_equals_brute_force_with_hot_accounts(table, rows_per_task):
    tx = normalize(table(random_rows(2, 300)))
    result = balance.running_balance(
        tx, ACCOUNT, rows_per_task=rows_per_task, rows_per_block=20
    )
    assert balances(result) == brute_balances(tx.collect(), keyed=True)


def test_one_day_that_holds_every_row_is_split(table):
    tx = normalize(table([row(i, "2024-01-01", i % 7 - 3) for i in range(500)]))
    got = balances(balance.running_balance(tx, rows_per_block=50))
    assert got == brute_balances(tx.collect(), keyed=False)


def test_missing_amount_has_no_balance_and_undated_come_last(table):
    tx = normalize(
        table(
            [
                row(0, None, 100),
                row(1, "2024-01-01", None),
                row(2, "2024-01-01", 5),
                row(3, "2024-01-01", None),
                row(4, "2024-01-02", -2),
            ]
        )
    )
    assert balances(balance.running_balance(tx)) == {0: 103.0, 1: None, 2: 5.0, 3: None, 4: 3.0}


def test_opening_balance(table):
    tx = normalize(table([row(0, "2024-01-01", 5), row(1, "2024-01-02", 5, account=2)]))
    opened = balance.running_balance(tx, ACCOUNT, opening=F.col("account_id") * 100)
    assert balances(opened) == {0: 105.0, 1: 205.0}


def test_empty_table(table):
    tx = normalize(table([]))
    assert balance.running_balance(tx).count() == 0
    assert balance.running_balance(tx, ACCOUNT).count() == 0


def test_last_balance_is_total_net(table):
    tx = normalize(table([r for r in random_rows(4, 200) if r[5] is not None]))
    line = balance.balance_line(tx).collect()
    assert line[-1].running_balance == float(tx.agg(F.sum("amount")).first()[0])


def test_bounds(table):
    tx = normalize(table([row(0, "2024-01-01", 5), row(1, "2024-03-01", 5), row(2, None, 5)]))
    assert rows_of(balance.balance_bounds(tx)) == [
        (dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1), 0.0)
    ]
