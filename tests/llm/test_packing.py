"""Packing: conflicts, capacity, completeness, and best fit against a plain search."""

from __future__ import annotations

import random

import pytest

from ledger_spark.llm.ngram_join import ngram_components
from ledger_spark.llm.packing import best_fit, fill_rate, packed


def plain(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fit = [(room, i) for i, (room, s, c) in enumerate(bins) if room >= size and not s & source and not c & cluster]
        if fit:
            room, i = min(fit)
        else:
            room, i = capacity, len(bins)
            bins.append((capacity, 0, 0))
        out.append((i, capacity - room))
        _, s, c = bins[i]
        bins[i] = (room - size, s | source, c | cluster)
    return out


def test_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(60):
        pieces = [(rng.randrange(1, 60), 1 << rng.choice([0, 0, 0, 1, 2, 3, 4]), 1 << rng.randrange(25)) for _ in range(150)]
        assert list(zip(*best_fit(pieces, 60))) == plain(pieces, 60)
        pieces.sort(key=lambda p: -p[0])
        assert list(zip(*best_fit(pieces, 60))) == plain(pieces, 60)


def bins_of(rows):
    out = {}
    for r in rows:
        out.setdefault((r["group"], r["bin"]), []).append(r)
    return out


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packed(docs, 4096, 200).collect()
    for held in bins_of(rows).values():
        held.sort(key=lambda r: r["offset"])
        assert sum(r["size"] for r in held) <= 4096
        assert all(a["offset"] + a["size"] == b["offset"] for a, b in zip(held, held[1:])) and held[0]["offset"] == 0
        assert len({r["source"] for r in held}) == len(held) == len({r["cluster"] for r in held})
    sizes = {r[0]: len((r[1] or "").encode()) + 1 for r in docs.select("doc_id", "text").collect()}
    parts = {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append((r["start"], r["size"]))
    assert parts.keys() == sizes.keys()
    for doc, found in parts.items():
        at = 0
        for start, size in sorted(found):
            assert start == at
            at += size
        assert at == sizes[doc]


def test_odd_rows(spark):
    rows = [(1, None, "a", 5), (2, "", "a", 5), (None, "x" * 10_000, None, 1), (3, "same", "b", 2), (3, "same", "b", 2), (4, "y" * 7, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, bin int")
    got = packed(docs, 100, 3).collect()
    assert sorted(((r["doc_id"] or 0) for r in got if r["piece"] == 0)) == [0, 1, 2, 3, 3, 4]
    assert sum(r["size"] for r in got) == 1 + 1 + 10_001 + 5 + 5 + 8
    for held in bins_of(got).values():
        assert len({r["source"] for r in held}) == len(held) == len({r["cluster"] for r in held})
    assert packed(docs.limit(0)).collect() == []


def test_near_copies_never_share_a_bin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    classes = ngram_components(docs, 5, 80)
    rows = packed(docs, classes=classes).collect()
    near = {r["doc_id"]: r["component_id"] for r in classes.collect()}
    assert len(set(near.values())) < len(near)
    assert all(r["near"] == near[r["doc_id"]] for r in rows)
    for held in bins_of(rows).values():
        assert len({r["near"] for r in held}) == len(held)


def test_rows_that_repeat_are_spread_over_groups(spark):
    big = (1 << 62) + 1
    rows = spark.range(100_000).selectExpr(f"{big} AS doc_id", "'ten bytes' AS text", "'a' AS source")
    rows = rows.union(spark.range(20_000).selectExpr("CAST(NULL AS BIGINT)", "'x'", "CAST(id AS STRING)"))
    classes = spark.createDataFrame([(big, 3), (big, 3), (None, 4)], "doc_id bigint, component_id bigint")
    got = packed(rows, classes=classes).cache()
    assert got.count() == 120_000 and got.filter(f"doc_id = {big} AND near = 3").count() == 100_000
    assert max(r["count"] for r in got.groupBy("group").count().collect()) < 20_000
    assert got.groupBy("group", "bin").agg({"cluster": "count"}).filter("`count(cluster)` > 2").count() == 0
    fill = fill_rate(got).first()
    assert fill["bytes"] == 100_000 * 10 + 20_000 * 2 and fill["fill"] == pytest.approx(fill["bytes"] / fill["bins"] / 8192)
