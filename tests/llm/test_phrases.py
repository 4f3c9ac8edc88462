"""Collocations: plain counting, the SQL twin, shards that do not matter, odd rows."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest

from ledger_spark.llm import phrases as ph
from ledger_spark.llm.queries import op12_son_phrases, statements
from tests.oracle_check import connect, difference

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    f = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f


def plain(rows, least, percent, top):
    out = []
    for lang, f in counts(rows).items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        often = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        found = []
        for w, a in often.items():
            if any(len(v) > len(w) and w in (v[:2], v[1:]) and 100 * c >= percent * a for v, c in often.items()):
                continue
            score, cut = min((1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), f[w[:cut]], f[w[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def made(seed, count=150):
    rng = random.Random(seed)
    words = ["The", "the", "of", "ÉA", "éa", "b-c", "\x1c", "x y", "d'", "\x00", "ß", *"efghij"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b", "　"]
    text = lambda: "".join(rng.choice(words[: rng.randrange(3, len(words))]) + rng.choice(ends) for _ in range(rng.randrange(40)))
    return [(rng.choice(["en", "de", None, ""]), rng.choice([None, "", text(), text()])) for _ in range(count)]


@pytest.mark.parametrize("least,shards,block", [(1, 1, 50), (2, 3, 7), (4, 4, 1000), (7, 9, 64), (10, 4, 1 << 19)])
def test_random_tables(spark, monkeypatch, least, shards, block):
    monkeypatch.setattr(ph, "BLOCK", block)
    rows = made(least)
    docs = spark.createDataFrame([(l, t, i) for i, (l, t) in enumerate(rows)], "lang string, text string, phrase int").repartition(7)
    for percent, top in ((50, 2000), (90, 5)):
        got = sorted(tuple(r) for r in ph.collocations(docs, least, percent, top, shards).collect())
        assert got == plain(rows, least, percent, top)


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(ph, "MOST_BITS", 1)
    rows = made(3)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in ph.collocations(docs, 3).collect()) == plain(rows, 3, 50, 2000)


def test_local_support_prunes(spark):
    """Sequences that are rare in every shard are no candidates; frequent ones all are."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(8)
    rows = ph._input(docs)
    enough = ph._supports(rows, 12, 4)
    local = rows.mapInArrow(ph._mined(4), "shard int, hash bigint, n bigint").groupBy("shard", "hash").sum("n")
    kept = local.filter(local["sum(n)"] >= enough).select("hash").distinct().count()
    table = counts([tuple(r) for r in docs.select("lang", "text").collect()])
    short = [c for f in table.values() for w, c in f.items() if len(w) < 3]
    assert sum(c >= 12 for c in short) <= kept < 0.3 * len(short)


def test_query_equals_sql(spark):
    assert difference(op12_son_phrases(spark, FOLDER), connect(FOLDER), statements()["op12_son_phrases"]) is None


def test_whole_numbers_beyond_64_bits(spark):
    big = 10**14
    row = spark.createDataFrame([(big, big, big + 1), (big, 3 * big, big)], "a bigint, l bigint, r bigint")
    got = [r[0] for r in row.select(ph._score("a", "l", "r")).collect()]
    assert got == [1_000_000 * big * big // (big * (big + 1)), 333_333]


def test_empty_and_long(spark):
    docs = spark.createDataFrame([("en", None)], "lang string, text string")
    assert ph.collocations(docs.limit(0)).collect() == [] and ph.collocations(docs).collect() == []
    long = spark.createDataFrame([("en", "a b c " * 200_000), ("en", "a b. " * 9)], "lang string, text string")
    got = [tuple(r) for r in ph.collocations(long).collect()]
    assert got == plain([("en", "a b c " * 200_000), ("en", "a b. " * 9)], 10, 50, 2000)


FULL = SimpleNamespace(value=b"\xff" * 4096)


def batch_of(rows):
    return pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows], pa.string())})


@pytest.mark.parametrize("slab,block", [(1, 1), (1, 100), (9, 2), (40, 7), (300, 1000)])
def test_texts_cut_anywhere(monkeypatch, slab, block):
    """Parts of long texts and blocks of few words together hold each sequence once."""
    monkeypatch.setattr(ph, "SLAB", slab)
    monkeypatch.setattr(ph, "BLOCK", block)
    rows = [("und" if lang is None else lang, text) for lang, text in made(slab + block)]
    got = Counter()
    for out in ph._counted((FULL, FULL))(iter([batch_of(rows[:80]), batch_of(rows[80:])])):
        for entry, n in zip(*(column.to_pylist() for column in out.columns)):
            got[tuple(entry.split("\n"))] += n
    want = Counter()
    for lang, f in counts(rows).items():
        for words, n in f.items():
            want[" ".join(words), lang] += n
            want["", lang] += n * (len(words) == 1)
    assert +got == +want


def test_few_rows_and_no_words_as_objects():
    """Of a million different words, bounded batches leave and no task holds them as Python objects."""
    rng = random.Random(5)
    words = [f"{rng.randrange(10**9):x}" for _ in range(1_000_000)]
    batch = batch_of([("en", " ".join(words[i : i + 500])) for i in range(0, len(words), 500)])
    del words
    tracemalloc.start()
    sizes = [out.num_rows for out in ph._counted((FULL, FULL))(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) > 2_900_000 and max(sizes) <= 1 << 16
    assert peak < 200 << 20
