"""Exact moments: bounds in whole numbers, any order, any size of amount."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import patterns, score
from ledger_spark.operators.normalize import normalize
from ledger_spark.operators.rollup import base_cells
from ledger_spark.plans import requests
from ledger_spark.staging import stage
from tests.conftest import random_rows, row, rows_of

ACCOUNT = ["account_id"]


def bound(cents):
    """The largest expense in cents that is not unusual."""
    n, s, q = len(cents), sum(cents), sum(c * c for c in cents)
    return (s + math.isqrt(4 * n * (n * q - s * s) // (n - 1))) // n


def stats_of(table, amounts):
    return patterns.expense_stats(normalize(table([row(i, "2024-01-01", a) for i, a in enumerate(amounts)])))


@pytest.mark.parametrize("digits", [1, 3, 6, 9, 12, 15])
def test_bounds_equal_whole_number_arithmetic(table, digits):
    rng = random.Random(digits)
    for _ in range(6):
        cents = [rng.randrange(1, 10**digits) for _ in range(rng.choice([2, 3, 7, 40]))]
        found = stats_of(table, [-Decimal(c) / 100 for c in cents] + [5, None]).first()
        assert found.large_bound == -Decimal(bound(cents)) / 100
        assert found.expenses == len(cents) and found.rows == len(cents) + 2
        n, s, q = len(cents), sum(cents), sum(c * c for c in cents)
        assert math.isclose(found.expense_stddev, math.sqrt((n * q - s * s) / (n * (n - 1))) / 100, rel_tol=1e-13)


def test_equal_amounts_and_small_roots(table):
    for cents in ([1, 1], [1, 2], [70] * 9, [1, 1, 1, 3], [99] * 50 + [100], [10**16 - 1, 10**16]):
        assert stats_of(table, [-Decimal(c) / 100 for c in cents]).first().large_bound == -Decimal(bound(cents)) / 100


def test_the_largest_amounts_do_not_overflow(table):
    """Sums of squares beyond 38 digits: the bound is then a rounded one."""
    top = Decimal(10**18 - 1) / 100
    amounts = [-top] * 300 + [-1] * 300
    found = stats_of(table, amounts).first()
    mean = (10**18 - 1 + 100) / 2
    assert abs(float(-found.large_bound) * 100 / (mean * (1 + 2 * math.sqrt(600 / 599))) - 1) < 1e-9
    assert abs(float(stats_of(table, [-top] * 300).first().large_bound / top) + 1) < 1e-12


def test_none_and_one(table):
    for amounts in ([], [5, None], [-7]):
        found = stats_of(table, amounts).first()
        assert found.large_bound is None and found.expense_stddev is None
        assert found.expenses == sum(a is not None and a < 0 for a in amounts)


@pytest.mark.parametrize("keys", [[], ACCOUNT])
def test_partitions_and_cells_give_the_same_figures(table, keys):
    tx = normalize(table(random_rows(41, 900)))
    expected = rows_of(patterns.expense_stats(tx, keys))
    large = rows_of(patterns.large_expenses(tx, keys))
    for parts in (1, 3, 50):
        dealt = tx.repartition(parts, F.rand(parts))
        assert rows_of(patterns.expense_stats(dealt, keys)) == expected
        assert rows_of(patterns.large_expenses(dealt, keys)) == large
        cells = base_cells(dealt, keys, moments=True)
        got = patterns.expense_stats(keys=keys, cells=cells)
        assert rows_of(got.select(patterns.expense_stats(tx, keys).columns)) == expected


def test_cells_without_moments_are_refused(table):
    with pytest.raises(ValueError):
        patterns.expense_stats(cells=base_cells(normalize(table([]))))


@pytest.mark.parametrize("keys", [[], ACCOUNT])
def test_three_reads_at_most(table, monkeypatch, keys):
    """Scans of the transactions, those of staged tables on the way included."""
    tx = stage(normalize(table(random_rows(42, 500))), "stored")
    name = tx.inputFiles()[0].rsplit("/", 2)[1]

    def count(df):
        leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
        scanned = [leaves.apply(i) for i in range(leaves.size())]
        scanned = [x for x in scanned if "FileSourceScanExec" in x.getClass().getName()]
        return sum(name in x.relation().location().rootPaths().apply(0).toString() for x in scanned)

    total = []

    def watched(df, label):
        total.append(count(df))
        return stage(df, label)

    for module in (patterns, score, requests):
        monkeypatch.setattr(module, "stage", watched)
    facts = requests.account_facts(tx, keys)
    assert sum(total) + count(facts) == 3
    total.clear()
    scored = score.health_score(tx, keys)
    assert sum(total) + count(scored) == 3
    assert "Window" not in scored._jdf.queryExecution().optimizedPlan().toString()
