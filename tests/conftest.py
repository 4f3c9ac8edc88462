from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest

from ledger_spark.schema import TRANSACTIONS
from ledger_spark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[8]",
        shuffle_partitions=4,
        extra={
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def row(seq, date, amount, description="x", type=None, category=None, account=1, statement=None):
    """One transaction with short spellings for its values."""
    if isinstance(date, str):
        date = dt.datetime.fromisoformat(date)
    amount = None if amount is None else Decimal(str(amount))
    return (statement or f"s{account}", seq, account, date, description, amount, type, category)


@pytest.fixture(scope="session")
def table(spark):
    """Transaction table from rows made with ``row``."""

    def build(rows):
        return spark.createDataFrame(rows, TRANSACTIONS)

    return build


def random_rows(seed: int, n: int, accounts: int = 4, hot_share: float = 0.4):
    """Rows with missing values, shared days, and one account that holds many."""
    rng = random.Random(seed)
    start = dt.datetime(2023, 11, 1)
    rows = []
    for seq in range(n):
        account = 1 if rng.random() < hot_share else rng.choice([*range(2, accounts + 1), None])
        date = start + dt.timedelta(days=rng.randrange(120), hours=rng.choice([0, 0, 5, 9]))
        rows.append(
            row(
                seq,
                None if rng.random() < 0.05 else date,
                None if rng.random() < 0.05 else round(rng.uniform(-900, 700), 2),
                None if rng.random() < 0.05 else f"shop {rng.randrange(12)}",
                rng.choice(["debit", "credit", "DEBIT", None]),
                rng.choice(["Food", "Travel", "Fees", "Health", None]),
                account,
                statement=f"s{rng.randrange(3)}",
            )
        )
    return rows


def rows_of(df, *columns):
    """Collected rows as a sorted list of tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
