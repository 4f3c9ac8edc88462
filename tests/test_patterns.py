from __future__ import annotations

import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledger_spark import keyed
from ledger_spark.keyed import hot_keys, lookup_by_key
from ledger_spark.operators import patterns, score
from ledger_spark.operators.normalize import normalize
from tests.conftest import random_rows, row, rows_of

ACCOUNT = ["account_id"]


def expenses(table, amounts, **more):
    return normalize(table([row(i, "2024-01-01", a, **more) for i, a in enumerate(amounts)]))


def seqs(df):
    return sorted(r.seq for r in df.collect())


@pytest.mark.parametrize(
    "amounts, expected",
    [
        ([], []),
        ([-9], []),
        ([-1, -9], []),
        ([-0.1] * 3, []),  # equal amounts, where sum / n rounds
        ([-0.7] * 9, []),
        ([-1] * 20 + [-50], [20]),
        ([-50] + [-1] * 30 + [-90, 5], [0, 31]),
    ],
)
@pytest.mark.parametrize("keys", [[], ACCOUNT])
def test_large_expenses(table, amounts, expected, keys):
    assert seqs(patterns.large_expenses(expenses(table, amounts), keys)) == expected


@pytest.mark.parametrize("count, kept", [(2, [0, 1]), (3, [0, 1, 2]), (4, [0, 1, 2])])
def test_first_large_expenses_go_by_record_order(table, count, kept):
    amounts = [-500 - i for i in range(count)] + [-1] * 60
    assert seqs(patterns.first_large_expenses(expenses(table, amounts))) == kept


def brute_large(rows):
    """Row numbers of unusual expenses per account."""
    groups: dict = {}
    for r in rows:
        if r.amount is not None and r.amount < 0:
            groups.setdefault(r.account_id, []).append(r)
    found = []
    for members in groups.values():
        values = [float(r.amount) for r in members]
        if len(values) > 1:
            bound = statistics.fmean(values) - 2 * statistics.stdev(values)
            found += [r.seq for r in members if float(r.amount) < bound]
    return sorted(found)


@pytest.mark.parametrize("rows_per_task", [3, 25, 5_000_000])
def test_large_expenses_per_account_with_hot_accounts(table, rows_per_task):
    rows = random_rows(21, 400)
    rows += [row(1000 + i, "2024-01-01", -5000, account=a) for i, a in enumerate([1, 2, None])]
    tx = normalize(table(rows))
    got = patterns.large_expenses(tx, ACCOUNT, rows_per_task=rows_per_task)
    assert seqs(got) == brute_large(tx.collect())
    assert len(seqs(got)) >= 3


def test_hot_keys_are_split_and_bounded(table):
    tx = table(random_rows(22, 400))
    sizes = tx.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    hot = {r.account_id: (r.n, r["__parts"]) for r in hot_keys(sizes, ACCOUNT, "n", 100).collect()}
    assert list(hot) == [1] and hot[1][1] == -(-hot[1][0] // 100)
    assert hot_keys(sizes, ACCOUNT, "n", 1000) is None


@pytest.mark.parametrize("broadcast_keys", [0, 100])
def test_lookup_keeps_every_row_once(table, monkeypatch, broadcast_keys):
    monkeypatch.setattr(keyed, "MAX_BROADCAST_KEYS", broadcast_keys)
    tx = table(random_rows(23, 400))
    sizes = tx.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup_by_key(tx, sizes, ACCOUNT, "n", ["statement_id", "seq"], rows_per_task=10)
    assert joined.columns == [*tx.columns, "n"]
    assert rows_of(joined, *tx.columns) == rows_of(tx)


def test_small_expense_bound_is_exclusive(table):
    tx = expenses(table, [-500, -499.99, -1, 0, 20, None])
    assert patterns.small_expense_count(tx).first()[0] == 2
    assert patterns.small_expense_count(tx, small=-1000).first()[0] == 3


def test_recurring_needs_two_and_ties_go_by_name(table):
    names = "f f e e d d c c b b a a a z".split()
    tx = normalize(table([row(i, None, -1, n) for i, n in enumerate(names)]))
    assert [r.description for r in patterns.recurring_expenses(tx).collect()] == list("abcde")
    assert patterns.recurring_descriptions(tx).count() == 6
    assert patterns.expense_frequency(tx).count() == 7


def test_missing_descriptions_are_left_out(table):
    tx = normalize(table([row(0, None, 5, None), row(1, None, -5, None), row(2, None, -5, None)]))
    assert patterns.top_income_sources(tx).count() == 0
    assert patterns.recurring_expenses(tx).count() == 0


def test_top_income_sources(table):
    tx = normalize(
        table([row(i, None, a, d) for i, (d, a) in enumerate([("a", 5), ("b", 9), ("a", 4), ("c", 1), ("d", 1)])])
    )
    assert [tuple(r) for r in patterns.top_income_sources(tx).collect()] == [("a", 9.0), ("b", 9.0), ("c", 1.0)]
    assert patterns.income_by_description(tx).count() == 4


def test_pattern_record_has_empty_lists_where_nothing_is_found(table):
    tx = normalize(table([row(0, "2024-01-01", 5, "pay"), row(1, "2024-01-01", None, account=2)]))
    records = {r.account_id: r for r in patterns.pattern_record(tx, ACCOUNT).collect()}
    assert records[1].top_income_sources == {"pay": 5.0}
    assert records[2].top_income_sources == {} and records[2].category_expenses == {}
    assert records[2].recurring_expenses == [] and records[2].large_transactions == []
    assert records[2].small_expense_count == 0


def test_pattern_record_of_nothing(table):
    only = patterns.pattern_record(normalize(table([]))).collect()
    assert len(only) == 1 and only[0].small_expense_count == 0 and only[0].category_expenses == {}


def test_category_map_is_always_whole(table):
    tx = normalize(table([row(i, None, -1 - i, category=f"c{i}") for i in range(10_500)]))
    found = patterns.pattern_record(tx).first().category_expenses
    assert len(found) == 10_500 and found["c10499"] == 10_500.0


def points(spark, **facts):
    base = dict(net=-1.0, rate=5.0, sources=0, labels=0, large=0, small=0)
    base.update(facts)
    schema = "net double, rate double, sources long, labels long, large long, small long"
    df = spark.createDataFrame([tuple(base[c] for c in base)], schema)
    return df.select(score.score_expression(*[F.col(c) for c in base])).first()[0]


@pytest.mark.parametrize(
    "rate, expected",
    [(-1, 35), (0, 50), (10, 50), (10.01, 55), (20.01, 60), (30, 60), (30.01, 65), (None, 50)],
)
def test_savings_steps(spark, rate, expected):
    assert points(spark, rate=None if rate is None else float(rate)) == expected


def test_other_rules(spark):
    assert points(spark, net=0.0) == 50 and points(spark, net=0.01) == 60
    assert points(spark, labels=8) == 50 and points(spark, labels=9) == 45
    assert points(spark, sources=2) == 50 and points(spark, sources=3) == 55
    assert points(spark, large=2) == 50 and points(spark, large=3) == 45
    assert points(spark, small=20) == 50 and points(spark, small=21) == 45
    assert points(spark, net=1.0, rate=31.0, sources=3) == 80
    assert points(spark, rate=-1.0, labels=9, large=3, small=21) == 20


@pytest.mark.parametrize(
    "value, colour, start",
    [
        (19, "#dc3545", "Immediate"),
        (20, "#dc3545", "Financial"),
        (39, "#dc3545", "Financial"),
        (40, "#ffc107", "Average"),
        (59, "#ffc107", "Average"),
        (60, "#ffc107", "Good"),
        (69, "#ffc107", "Good"),
        (70, "#28a745", "Good"),
        (79, "#28a745", "Good"),
        (80, "#28a745", "Excellent"),
        (None, "#ffc107", "Average"),
    ],
)
def test_bands(spark, value, colour, start):
    df = score.health_bands(spark.createDataFrame([(value,)], "health_score int"))
    only = df.first()
    assert only.health_color == colour and only.health_message.startswith(start)


def test_scores_stay_in_reach_and_whole_table_equals_one_account(table):
    tx = normalize(table(random_rows(24, 400)))
    scores = {r.account_id: r for r in score.health_score(tx, ACCOUNT, rows_per_task=50).collect()}
    assert all(20 <= r.health_score <= 80 for r in scores.values())
    alone = score.health_score(tx.filter("account_id = 1")).first()
    assert alone.asDict() == {k: v for k, v in scores[1].asDict().items() if k != "account_id"}


def test_score_of_nothing_is_neutral(table):
    assert score.health_score(normalize(table([]))).first().health_score == 50


def test_exact_sums_survive_rounding(table):
    tx = normalize(table([row(i, "2024-01-01", "0.10", "pay") for i in range(10)]))
    assert patterns.top_income_sources(tx).first().amount == float(Decimal("1.00"))
