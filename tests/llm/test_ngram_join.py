"""Word n-gram Jaccard components against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from ledger_spark.llm import ngram_join as nj
from ledger_spark.llm.ngram_join import ngram_components
from ledger_spark.staging import stage
from tests.llm.brute import jaccard_components


def texts_with_copies(seed: int, n: int = 260):
    """Short texts, a hot family of near copies, shared passages and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 4)))
    base = [word() for _ in range(60)]
    shared = [word() for _ in range(25)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35:
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = word()
            words = words[: rng.randrange(50, 61)]
        elif kind < 0.6:
            words = shared + [word() for _ in range(rng.randrange(0, 12))]
        elif kind < 0.7:
            words = ["a"] * rng.randrange(0, 6)
        else:
            words = [word() for _ in range(rng.randrange(1, 30))]
        out.append(" ".join(w.upper() if rng.random() < 0.02 else w for w in words))
    return out


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_equals_all_pairs(spark, seed, n, percent):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts_with_copies(seed))] + [(0, None), (2, ""), (5, " \t\n"), (3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in ngram_components(docs, n, percent).collect()}
    assert got == jaccard_components(rows, n, percent)


def test_many_large_columns(spark, monkeypatch):
    """The pivot turns and the remaining pairs give the same as all pairs."""
    monkeypatch.setattr("ledger_spark.llm.ngram_join.SMALL_COLUMN", 2)
    monkeypatch.setattr("ledger_spark.llm.ngram_join.LARGE_COUNT", 8)
    monkeypatch.setattr("ledger_spark.llm.ngram_join.EVEN", 0)
    rows = list(enumerate(texts_with_copies(7, 300)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in ngram_components(docs, 3, 70).collect()}
    assert got == jaccard_components(rows, 3, 70)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", "y"), (7, "A B\tC D E", None), (9, long, "q"), (8, long + " z", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = sorted((tuple(r) for r in ngram_components(docs).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (7, 2, 1), (9, 29997, 8), (8, 29998, 8)], key=repr)
    assert ngram_components(docs.limit(0)).collect() == []


def test_rows_of_one_document_are_linked(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "p q r s t"), (3, "p q r s t"), (4, "u v w x y")]
    got = {r[0]: r[2] for r in ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def all_large(monkeypatch, block):
    for name, value in (("SMALL_COLUMN", 2), ("LARGE_COUNT", 8), ("EVEN", 0), ("BLOCK", block)):
        monkeypatch.setattr(f"ledger_spark.llm.ngram_join.{name}", value)


def brought_out(monkeypatch):
    """Links that blocks give out, and rows that they take in."""
    found, whole = [], nj._within_groups

    def watched(*given):
        out = stage(whole(*given), "watched")
        found.append((out.count(), given[1].select("id").distinct().count()))
        return out

    monkeypatch.setattr(nj, "_within_groups", watched)
    return found


@pytest.mark.parametrize("block", [16, 2048])
def test_large_columns_whose_rows_are_not_linked(spark, monkeypatch, block):
    """Texts that share most of a long passage, but too little to be linked."""
    all_large(monkeypatch, block)
    found = brought_out(monkeypatch)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(240):
        words = list(passage)
        for _ in range(rng.choice([1, 2, 3, 3, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in ngram_components(docs, 3, 88).collect()}
    assert got == jaccard_components(rows, 3, 88)
    assert len({c for _, c in got.values()}) > 40
    assert found and all(links <= taken * max(1, -(-240 // block)) for links, taken in found)


def test_a_chain_of_documents(spark, monkeypatch):
    """Each text is like the next one only."""
    all_large(monkeypatch, 64)
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[i : i + 60])) for i in range(200)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r[2] for r in ngram_components(docs, 4, 90).collect()} == {0}


def test_a_wrong_link_is_found_again(spark, monkeypatch):
    """Shortened hashes that make everything look alike in the first turn."""
    all_large(monkeypatch, 2048)
    true, seen = nj._verified, []

    def doubting(docs, pairs, *more):
        seen.append(pairs.count())
        out = true(docs, pairs, *more)
        # the first links of the blocks are taken for wrong ones
        return out.limit(0) if len(seen) == 3 else out

    monkeypatch.setattr(nj, "_verified", doubting)
    rows = list(enumerate(texts_with_copies(7, 200)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in ngram_components(docs, 3, 70).collect()}
    assert got == jaccard_components(rows, 3, 70) and len(seen) > 3


def texts_with_passages(rng, n=240):
    """Texts of a few words of their own and some of many passages."""
    passages = [" ".join(f"p{k}.{i}" for i in range(40)) for k in range(30)]
    out = []
    for i in range(n):
        parts = [" ".join(f"w{i}.{j}.{k}" for k in range(3)) for j in range(3)]
        out.append(" ".join(x for pair in zip(parts, rng.sample(passages, 3)) for x in pair))
    return out


def compared_whole(monkeypatch):
    """Numbers of rows that come with their whole sets."""
    whole = []

    def watched(df, label):
        out = stage(df, label)
        whole.extend([out.count()] * (label == "members"))
        return out

    monkeypatch.setattr(nj, "stage", watched)
    return whole


@pytest.mark.parametrize("n,percent", [(3, 80), (5, 80)])
def test_rows_that_share_passages_only_are_not_compared_whole(spark, monkeypatch, n, percent):
    """Passages connect all texts, but sketches show that few of them are alike."""
    all_large(monkeypatch, 16)
    whole = compared_whole(monkeypatch)
    texts = texts_with_passages(random.Random(5))
    copies = [(1000 + i, text + " z" * (i % 3)) for i, text in enumerate(texts[:20])]
    rows = list(enumerate(texts)) + copies
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in ngram_components(docs, n, percent).collect()}
    assert got == jaccard_components(rows, n, percent)
    assert whole and sum(whole) <= len(rows) // 4


def test_near_duplicates_of_the_pipeline_with_shared_passages(spark, monkeypatch):
    """One of each group stays, and few rows are compared whole."""
    all_large(monkeypatch, 16)
    whole = compared_whole(monkeypatch)
    texts = texts_with_passages(random.Random(9), 200)
    rows = list(enumerate(texts)) + [(1000 + i, text + " z") for i, text in enumerate(texts[:20])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r[0] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, (_, root) in jaccard_components(rows, 5, 80).items() if i == root}
    assert whole and sum(whole) <= len(rows) // 4


def test_repeated_ids_in_large_columns(spark, monkeypatch):
    """An id with several texts has no sketch, and each of its texts is compared."""
    all_large(monkeypatch, 16)
    rng = random.Random(6)
    texts = texts_with_passages(rng, 60)
    rows = list(enumerate(texts)) + [(7, texts[40] + " z"), (7, "other words here"), (200, texts[7] + " y"), (201, texts[50] + " y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r[0], r[2]) for r in ngram_components(docs, 3, 80).collect()}
    linked = {40: 7, 200: 7, 201: 50}
    assert got == {(i, linked.get(i, i)) for i, _ in rows}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 60, 200, 3000):
        a = np.unique(rng.integers(0, 1 << 57, size, np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 57, size // 2, np.uint64)])
        x, y = (np.frombuffer(nj.sketch(s), np.uint64) for s in (a, b))
        words = min(len(x), len(y))
        apart = int(np.bitwise_count(nj.folded(x, words) ^ nj.folded(y, words)).sum())
        assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0
        assert len(x) * 64 <= max(64, 2 * len(a))
