"""Ordered running sums that no single task has to carry alone.

A window over a whole table, or over an account that holds a large share of it,
would put all its rows in one task. Rows that need it are therefore cut into
order-preserving blocks by range partitioning. Each block sums on its own and
adds the total of the blocks before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.keyed import MAX_BROADCAST_KEYS, ROWS_PER_TASK, hot_keys, join_on_keys
from ledger_spark.staging import stage

# Block sizes: the most rows a block should hold, and the fewest worth a task.
ROWS_PER_BLOCK = 1_000_000
MAX_BLOCKS = 20_000
SMALL_BLOCK = 10_000


def running_sum(
    rows: DataFrame,
    value: Column,
    order: Sequence[Column],
    out: str,
    keys: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``out``, the sum of ``value`` up to and including each row.

    ``order`` should identify a row within its key. Keys of ordinary size use
    one window over one shuffle; keys above ``rows_per_task`` rows, and a whole
    table (``keys=()``), are cut into blocks. The rows of a whole table come out in
    order: partition by partition, and within each.
    """
    if not keys:
        return _in_blocks(rows, value, order, out, keys, rows.count(), rows_per_block)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = hot_keys(sizes, keys, "__n", rows_per_task)
    if hot is None:
        return _in_windows(rows, value, order, out, keys)
    hot = stage(hot, "hot-keys")
    hot_count, hot_rows = hot.agg(F.count(F.lit(1)), F.sum("__n")).first()
    marks = hot.select(*keys)
    if hot_count <= MAX_BROADCAST_KEYS:
        marks = F.broadcast(marks)
    cold = _in_windows(join_on_keys(rows, marks, keys, "left_anti"), value, order, out, keys)
    split = _in_blocks(
        join_on_keys(rows, marks, keys, "left_semi"),
        value,
        order,
        out,
        keys,
        hot_rows,
        rows_per_block,
    )
    return cold.unionByName(split)


def _in_windows(
    rows: DataFrame, value: Column, order: Sequence[Column], out: str, keys: Sequence[str]
) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.sum(value).over(upto))


def _block_count(rows: DataFrame, total: int, rows_per_block: int) -> int:
    """Enough blocks to bound their size, and to use the cluster if worth it.

    There are at most ``MAX_BLOCKS``: beyond that, blocks grow with the table, so
    that the number of tasks and the carry table stay bounded. Results are equal
    for any number; blocks are about even, as their bounds come from a sample.
    """
    rows_per_block = max(rows_per_block, total / MAX_BLOCKS)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(
        1, math.ceil(total / rows_per_block), min(usual, math.ceil(total / SMALL_BLOCK))
    )


def _in_blocks(
    rows: DataFrame,
    value: Column,
    order: Sequence[Column],
    out: str,
    keys: Sequence[str],
    total: int,
    rows_per_block: int,
) -> DataFrame:
    """Running sum over blocks of a range partitioning by key and order.

    The block numbers depend on sampled range bounds, so the blocks are written
    out once and both uses read the same numbers. Each block then goes to a
    partition of its own; hashing its number would pile several onto one task.
    Only a key that began in an earlier block carries a sum in, and each block
    has at most one such key: the carry table has fewer rows than there are
    blocks and is broadcast.
    """
    n = _block_count(rows, total, rows_per_block)
    placed = rows.repartitionByRange(n, *keys, *order).withColumn(
        "__block", F.spark_partition_id()
    )
    blocks = stage(placed, "blocks")

    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocks.groupBy(*keys, "__block")
        .agg(F.sum(value).alias("__sum"))
        .withColumn("__carry", F.sum("__sum").over(before))
        .filter(F.col("__carry").isNotNull())
        .select(*keys, "__block", "__carry")
    )
    own_tasks = blocks.repartitionById(n, "__block")
    summed = _in_windows(own_tasks, value, order, out, [*keys, "__block"])
    joined = join_on_keys(summed, F.broadcast(carry), [*keys, "__block"], "left")
    whole = F.coalesce("__carry", F.lit(0)) + F.col(out)
    return joined.withColumn(out, whole).drop("__block", "__carry")
