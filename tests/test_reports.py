from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import categories, monthly, summary
from ledger_spark.operators.normalize import normalize
from ledger_spark.operators.rollup import base_cells
from ledger_spark.plans.reports import analyse
from tests.conftest import random_rows, row, rows_of

ACCOUNT = ["account_id"]


@pytest.fixture(scope="module")
def months(table):
    return normalize(
        table(
            [
                row(0, "2024-01-05", 1000),
                row(1, "2024-01-09", -998.75),
                row(2, "2024-02-01", -50),
                row(3, "2024-03-01", 80),
                row(4, "2024-05-01", None),
                row(5, "2024-06-01", 0),
                row(6, None, -7),
            ]
        )
    )


def test_monthly_cash_flow_keeps_empty_sums_and_drops_undated(months):
    assert [tuple(r) for r in monthly.monthly_cash_flow(months).collect()] == [
        ("2024-01", 1.25, 2),
        ("2024-02", -50.0, 1),
        ("2024-03", 80.0, 1),
        ("2024-05", 0.0, 0),
        ("2024-06", 0.0, 1),
    ]


def test_months_without_flow_are_absent_and_ties_round_to_even(months):
    assert [tuple(r) for r in monthly.monthly_income_vs_expenses(months).collect()] == [
        ("2024-01", 1000.0, 998.75, 1.25, 0.12),  # 0.125 percent
        ("2024-02", 0.0, 50.0, -50.0, 0.0),
        ("2024-03", 80.0, 0.0, 80.0, 100.0),
    ]


def test_bars_and_rate_series(months):
    assert monthly.monthly_bars(months).columns == ["year_month", "income", "expenses"]
    series = monthly.savings_rate_series(months).collect()
    assert [(r.savings_rate, r.target) for r in series] == [(0.12, 20.0), (0.0, 20.0), (100.0, 20.0)]


def test_summary_counts_undated_rows_but_not_in_means(months):
    only = summary.summary(months).first()
    assert only.asDict() == {
        "total_income": 1080.0,
        "total_expenses": 1055.75,
        "net_flow": 24.25,
        "avg_monthly_income": 360.0,
        "avg_monthly_expenses": 1048.75 / 3,
        "avg_savings_rate": 100.12 / 3,
        "top_expense_category": "Other",
        "top_expense_amount": 1055.75,
        "transaction_count": 7,
        "date_range": "2024-01-05 to 2024-06-01",
    }


def test_summary_of_nothing(table):
    only = summary.summary(normalize(table([]))).first()
    assert only.transaction_count == 0 and only.net_flow == 0.0 and only.top_expense_amount == 0.0
    assert only.avg_monthly_income is None and only.date_range is None
    assert only.top_expense_category is None
    assert summary.summary(normalize(table([])), ACCOUNT).count() == 0


def test_summary_without_any_date(table):
    only = summary.summary(normalize(table([row(0, None, -5)]))).first()
    assert only.date_range is None and only.total_expenses == 5.0 and only.avg_savings_rate is None


def test_missing_category_column_empties_category_reports(table):
    tx = normalize(table([row(0, "2024-01-01", -5)]).drop("category"))
    assert categories.category_spending(tx).count() == 0
    assert categories.monthly_category_spending(tx).count() == 0
    assert categories.spending_breakdown(tx).count() == 0
    only = summary.summary(tx).first()
    assert only.top_expense_category is None and only.total_expenses == 5.0


def test_category_spending_is_sorted_with_ties_by_name(table):
    tx = normalize(
        table(
            [
                row(0, "2024-01-01", -5, category="b"),
                row(1, None, -5, category="a"),
                row(2, "2024-01-01", -9, category="c"),
                row(3, "2024-01-01", 9, category="d"),
            ]
        )
    )
    assert [tuple(r) for r in categories.category_spending(tx).collect()] == [
        ("c", 9.0),
        ("a", 5.0),
        ("b", 5.0),
    ]
    assert [tuple(r) for r in categories.top_categories(tx, n=2).collect()] == [("c", 9.0), ("a", 5.0)]


@pytest.mark.parametrize("count, expected", [(0, 0), (1, 1), (10, 10), (11, 10), (25, 10)])
@pytest.mark.parametrize("keys", [[], ACCOUNT])
def test_breakdown_sizes_and_total(table, count, expected, keys):
    tx = normalize(
        table([row(i, "2024-01-01", -(i + 1), category=f"c{i:02}") for i in range(count)])
    )
    slices = categories.spending_breakdown(tx, keys).collect()
    assert len(slices) == expected
    assert sum(s.amount for s in slices) == count * (count + 1) / 2
    assert sum(s.is_bucket for s in slices) == (1 if count > 10 else 0)
    if slices:
        assert sum(s.share for s in slices) == pytest.approx(100)


def test_breakdown_keeps_a_real_other_beside_the_bucket(table):
    rows = [row(i, "2024-01-01", -(i + 1), category=f"c{i:02}") for i in range(10)]
    tx = normalize(table([*rows, row(99, "2024-01-01", -500, category="Other")]))
    others = {r.is_bucket: r.amount for r in categories.spending_breakdown(tx).collect() if r.category == "Other"}
    assert others == {False: 500.0, True: 3.0}


def test_trend_equals_semi_join(table):
    tx = normalize(table(random_rows(5, 400)))
    for keys in ([], ACCOUNT):
        top = categories.top_categories(tx, keys, n=2).drop("amount")
        wide = categories.monthly_category_spending(tx, keys)
        condition = F.lit(True)
        for c in [*keys, "category"]:
            condition = condition & wide[c].eqNullSafe(top[c])
        expected = wide.join(top, condition, "left_semi")
        assert rows_of(categories.category_trend(tx, keys, n=2)) == rows_of(expected)


def brute_summary(rows):
    """Totals and means from plain Python rows (normalised)."""
    amounts = [r.amount for r in rows if r.amount is not None]
    per_month: dict[str, list[Decimal]] = {}
    for r in rows:
        if r.year_month is not None and r.amount:
            per_month.setdefault(r.year_month, []).append(r.amount)
    incomes = [sum((a for a in v if a > 0), Decimal(0)) for v in per_month.values()]
    return (
        float(sum((a for a in amounts if a > 0), Decimal(0))),
        float(-sum((a for a in amounts if a < 0), Decimal(0))),
        float(sum(amounts, Decimal(0))),
        len(rows),
        float(sum(incomes)) / len(incomes) if incomes else None,
    )


def test_summary_per_account_equals_brute_force(table):
    tx = normalize(table(random_rows(11, 500)))
    groups: dict = {}
    for r in tx.collect():
        groups.setdefault(r.account_id, []).append(r)
    got = {
        r.account_id: (
            r.total_income,
            r.total_expenses,
            r.net_flow,
            r.transaction_count,
            r.avg_monthly_income,
        )
        for r in summary.summary(tx, ACCOUNT).collect()
    }
    assert got == {k: brute_summary(v) for k, v in groups.items()}
    assert None in got


def test_cells_give_the_same_reports(table):
    tx = normalize(table(random_rows(3, 300)))
    for keys in ([], ACCOUNT):
        cells = base_cells(tx, keys)
        for report in (
            monthly.monthly_cash_flow,
            monthly.monthly_income_vs_expenses,
            categories.category_spending,
            categories.monthly_category_spending,
            categories.spending_breakdown,
            categories.category_trend,
            summary.summary,
        ):
            assert rows_of(report(tx, keys)) == rows_of(report(keys=keys, cells=cells)), report


def test_one_account_whole_table_equals_its_keyed_rows(table):
    tx = normalize(table(random_rows(8, 300)))
    analysis = analyse(tx, ACCOUNT)
    alone = analyse(tx.filter("account_id = 2"))
    for name in (
        "monthly_cash_flow",
        "monthly_income_vs_expenses",
        "monthly_bars",
        "savings_rate_series",
        "category_spending",
        "monthly_category_spending",
        "spending_breakdown",
        "category_trend",
        "summary",
        "running_balance",
    ):
        keyed = getattr(analysis, name)().filter("account_id = 2").drop("account_id")
        assert rows_of(keyed) == rows_of(getattr(alone, name)()), name


def test_partitioning_does_not_matter(table):
    tx = normalize(table(random_rows(9, 300)))
    for n in (1, 7):
        other = tx.repartition(n)
        assert rows_of(summary.summary(other, ACCOUNT)) == rows_of(summary.summary(tx, ACCOUNT))


def test_monthly_net_plus_undated_is_total_net(table):
    tx = normalize(table(random_rows(10, 300)))
    dated = monthly.monthly_cash_flow(tx).agg(F.sum("net_flow")).first()[0]
    undated = tx.filter("year_month is null").agg(F.sum("amount")).first()[0]
    assert dated + float(undated) == pytest.approx(summary.summary(tx).first().net_flow, abs=1e-6)


def test_date_bounds(months):
    only = summary.date_bounds(months).first()
    assert (str(only.min_date), str(only.max_date)) == ("2024-01-05", "2024-06-01")


def test_extreme_savings_rate_does_not_end_the_job(table):
    rows = [row(0, "2024-01-01", 0.01), row(1, "2024-01-02", -5 * 10**12), row(2, "2024-01-02", -5 * 10**12, account=2)]
    got = summary.summary(normalize(table(rows)), ("account_id",)).collect()
    assert {r.account_id for r in got} == {1, 2}
    assert min(r.avg_savings_rate for r in got) < -4e16
