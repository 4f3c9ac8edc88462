"""Shared building blocks for operators that run whole-table or per key.

``keys=()`` means one answer for the whole table, ``keys=("account_id",)`` one
answer per account. Null key values form a group of their own, so every join on
keys is null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that a single task may take before the key is split.
ROWS_PER_TASK = 5_000_000
# Hot keys up to which their list is broadcast.
MAX_BROADCAST_KEYS = 100_000


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Null-safe equi-join that keeps the left side's key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__{k}"])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__{k}" for k in keys])


def hot_keys(
    sizes: DataFrame, keys: Sequence[str], size_col: str, rows_per_task: int
) -> DataFrame | None:
    """Keys with more rows than one task should take, with size and part count.

    ``sizes`` has one row per key. Only the number of hot keys reaches the
    driver; their table is broadcast up to ``MAX_BROADCAST_KEYS`` and left to an
    ordinary join beyond that. ``None`` when no key is hot.
    """
    parts = F.ceil(F.col(size_col) / F.lit(rows_per_task)).cast("bigint")
    hot = sizes.filter(F.col(size_col) > rows_per_task).select(*keys, size_col, parts.alias("__parts"))
    count = hot.count()
    if not count:
        return None
    return F.broadcast(hot) if count <= MAX_BROADCAST_KEYS else hot


def lookup_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    size_col: str,
    row_id: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Attach a one-row-per-key ``table`` to ``rows``.

    A hot key is cut into parts by the hash of its row ids and its table row is
    repeated once per part, so no task receives the whole key. Without keys the
    table is a single row and is broadcast.
    """
    if not keys:
        return rows.crossJoin(F.broadcast(table))
    hot = hot_keys(table, keys, size_col, rows_per_task)
    if hot is None:
        return join_on_keys(rows, table, keys)
    hot = hot.select(*keys, "__parts")
    part = F.when(
        F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*row_id), F.col("__parts"))
    ).otherwise(F.lit(0))
    split_rows = join_on_keys(rows, hot, keys, "left").withColumn("__part", part.cast("bigint"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("__parts", F.lit(1).cast("bigint")) - 1)
    split_table = join_on_keys(table, hot, keys, "left").withColumn("__part", F.explode(parts))
    joined = join_on_keys(
        split_rows.drop("__parts"), split_table.drop("__parts"), [*keys, "__part"]
    )
    return joined.drop("__part")


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each key in the given order.

    Per key, Spark trims every map task to ``n`` rows per key before the
    shuffle, so a hot key costs no more than a cold one.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    name = rank or "__rank"
    if not keys:
        df = df.orderBy(*order).limit(n)
    kept = df.withColumn(name, number).filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)
