"""Every named query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from ledger_spark.plans import oracle
from ledger_spark.plans import queries as catalogue
from tests.oracle_check import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalogue.registry()
TWINS = oracle.statements()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_same_names():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, TWINS[name]) is None


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["year_month", "income", "expenses", "savings", "savings_rate"]
    assert result.count() > 0
