"""Connected components by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.staging import stage

_ENDS = "a bigint, b bigint"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of one partition by links from each end to its root.

    The partition's ends are held in memory; partitions are cut by size.
    """
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[v] != top:
            parent[v], v = top, parent[v]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ends = list(parent)
    yield pa.RecordBatch.from_pydict(
        {"a": pa.array(ends, pa.int64()), "b": pa.array([root(v) for v in ends], pa.int64())}
    )


def components(links: DataFrame) -> DataFrame:
    """Columns ``id`` and ``component`` (smallest id reachable) of all linked ids.

    ``links`` has bigint columns ``a`` and ``b``. Each partition first shrinks
    its links to a forest; then every id takes the smallest label among its
    neighbours and follows that label one step, until nothing changes. Only the
    number of changed labels reaches the driver. Labels are staged each round,
    so a lost executor repeats one round at most.
    """
    clean = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    forest = clean.mapInArrow(_forest, _ENDS).filter("a <> b")
    both = stage(forest.union(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    while True:
        near = labels.select(F.col("id").alias("b"), "component")
        heard = both.join(near, "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        told = labels.join(heard, "id").select(
            "id", F.col("component").alias("before"), F.least("component", "heard").alias("component")
        )
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = told.join(jump, "component", "left").select(
            "id", "before", F.least("component", F.coalesce("further", "component")).alias("component")
        )
        moved = stage(moved, "labels")
        labels = moved.select("id", "component")
        if moved.filter("before <> component").isEmpty():
            return labels
