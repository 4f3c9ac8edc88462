"""Sharding: even counts, gapless slots, few cut links, odd rows."""

from __future__ import annotations

import zlib

from ledger_spark.llm.sharding import shard_documents


def check(rows, got, shards):
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def cut(got):
    """Share of linked rows that are outside the main shard of their text."""
    held = {}
    for r in got:
        if r["linked"]:
            held.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    return sum(len(v) - max(map(v.count, set(v))) for v in held.values()) / max(1, sum(map(len, held.values())))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shard_documents(docs).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], got, 8)
    assert cut(got) < 0.1
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_hot_group_is_split_and_the_rest_stays_together(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 8}" if i % 3 == 1 else f"single {i}") for i in range(3000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()
    check(rows, got, 4)
    pairs = [r for r in got if r["linked"] and r["text_crc32"] != zlib.crc32(b"hot")]
    assert cut(pairs) < 0.1


def test_hot_group_fills_as_few_shards_as_it_needs(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 8}" if i % 3 == 1 else f"single {i}") for i in range(12_000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    check(rows, got, 8)
    hot = [r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot")]
    held = sorted((hot.count(s) for s in range(8)), reverse=True)
    # spread over all shards 0.55 of the group are in three; three shards of 1,500 could hold it
    assert sum(held[:3]) > 0.8 * len(hot) and sum(n * n for n in held) > 0.23 * len(hot) ** 2


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (None, "x"), (None, "x"), (5, "y"), (5, "y"), (6, "z" * 200_000)]
    docs = spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id bigint, text string, shard string")
    for shards in (1, 3, 8, 20):
        check(rows, shard_documents(docs, shards).collect(), shards)
    assert shard_documents(docs.limit(0)).collect() == []
