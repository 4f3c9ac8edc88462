from __future__ import annotations

import datetime as dt

import pytest

from ledger_spark.operators import explore
from ledger_spark.operators.normalize import normalize
from tests.conftest import row

D = dt.date


@pytest.fixture(scope="module")
def tx(table):
    return normalize(
        table(
            [
                row(0, "2024-01-01 23:59:59", -5, "Cafe a%b_c", "debit", "Food"),
                row(1, "2024-01-02", 7.5, "pay (June).", "credit", "Income"),
                row(2, "2024-01-03 10:00", -2, None, None, None),
                row(3, None, -1, "CAFE", "debit", "Food"),
                row(4, "2024-01-03 09:00", 1, "cafe", "other", "Fees"),
            ]
        )
    )


def seqs(df):
    return [r.seq for r in df.orderBy("seq").collect()]


def test_inactive_filters_keep_all(tx):
    assert seqs(explore.filter_transactions(tx)) == [0, 1, 2, 3, 4]
    assert seqs(explore.filter_transactions(tx, category=None, type=None, term="")) == [0, 1, 2, 3, 4]


def test_date_range_is_inclusive_by_day_and_needs_both_ends(tx):
    both = explore.filter_transactions(tx, start=D(2024, 1, 1), end=D(2024, 1, 2))
    assert seqs(both) == [0, 1]
    assert seqs(explore.filter_transactions(tx, start=D(2024, 1, 3), end=D(2024, 1, 3))) == [2, 4]
    assert seqs(explore.filter_transactions(tx, start=D(2024, 1, 3))) == [0, 1, 2, 3, 4]


def test_category_and_type(tx):
    assert seqs(explore.filter_transactions(tx, category="Other")) == [2]
    assert seqs(explore.filter_transactions(tx, category="Food", type="debit")) == [0, 3]


@pytest.mark.parametrize(
    "term, expected", [("CaFe", [0, 3, 4]), ("a%b_c", [0]), ("a.b", []), ("(", [1]), (".", [1]), ("zz", [])]
)
def test_search_is_literal_and_ignores_case(tx, term, expected):
    assert seqs(explore.filter_transactions(tx, term=term)) == expected


def test_display(tx):
    shown = explore.display_transactions(tx).collect()
    assert [r.seq for r in shown] == [2, 4, 1, 0, 3]
    assert [r.amount for r in shown] == ["₹-2.00", "₹1.00", "₹7.50", "₹-5.00", "₹-1.00"]
    assert shown[0].date == D(2024, 1, 3)


def test_large_display_amounts_are_not_grouped(table):
    shown = explore.display_transactions(table([row(0, "2024-01-01", "1234567.8")])).first()
    assert shown.amount == "₹1234567.80"


def test_totals(tx):
    assert tuple(explore.filtered_summary(tx).first()) == (5, 8.5, 8.0, 0.5)
    nothing = explore.filter_transactions(tx, term="zz")
    assert tuple(explore.filtered_summary(nothing).first()) == (0, 0.0, 0.0, 0.0)


def test_facets(tx):
    assert [r.choice for r in explore.category_facet(tx).collect()] == ["All", "Fees", "Food", "Income", "Other"]
    assert explore.TYPE_FACET == ("All", "credit", "debit")
