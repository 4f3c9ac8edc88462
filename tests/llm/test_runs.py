"""Runs of words: every stretch compared with a plain search, hard texts, odd rows."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np

from ledger_spark.llm import runs as r
from ledger_spark.llm.queries import op13_seed_extend_runs, planted_runs


def plain(words):
    """All runs by comparing every lag at every place."""
    n, out = len(words), []
    for q in range(1, n):
        t = 0
        while t + q < n:
            if words[t] != words[t + q]:
                t += 1
                continue
            end = t
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - t + q
            block = words[t : t + length]
            smaller = any(all(block[i] == block[i + p] for i in range(length - p)) for p in range(1, q))
            if length >= max(12, 2 * q) and not smaller:
                out.append((t, length, q))
            t = end + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def got(words):
    return r.word_runs(np.array(words, np.int64))


def test_random_words_of_few_kinds():
    rng = random.Random(5)
    for turn in range(1500):
        words = [rng.randrange(rng.choice([1, 2, 2, 2, 3])) for _ in range(rng.randrange(0, 70))]
        assert got(words) == plain(words), words


def test_words_made_of_repeats():
    """Nested repetitions, with an odd word here and there."""
    rng = random.Random(6)
    for turn in range(250):
        words = [rng.randrange(2) for _ in range(rng.randrange(1, 6))]
        while len(words) < 120:
            words = words * rng.randrange(1, 4) + words[: rng.randrange(len(words) + 1)]
            if rng.random() < 0.6:
                words.insert(rng.randrange(len(words)), rng.randrange(3))
        words = words[: rng.randrange(60, 200)]
        assert got(words) == plain(words), words


def test_runs_that_touch():
    """Two long runs of one short period, out of step, hold runs of many lags at their border."""
    for left in range(12, 60, 5):
        for right in range(12, 60, 7):
            for block in ([0, 1], [0, 0, 1], [0, 1, 0, 2, 1]):
                for skip in range(len(block)):
                    words = (block * 40)[:left] + (block * 40)[skip : skip + right]
                    assert got(words) == plain(words), words


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert got(b[:300]) == plain(b[:300])


def test_long_texts_take_little_time():
    started = time.perf_counter()
    assert got([7] * 1_000_000) == [(0, 1_000_000, 1)]
    block = list(range(1000))
    assert got(block * 300) == [(0, 300_000, 1000)]
    rng = random.Random(2)
    half = [rng.randrange(50) for _ in range(100_000)]
    assert (0, 200_000, 100_000) in got(half + half)
    ab = [0, 1] * 10_000
    assert len(got(ab + [1] + ab)) >= 1
    assert time.perf_counter() - started < 60


def expected(doc, text, prepare=None):
    words = (text or "").encode().split()
    words = prepare(doc, words) if prepare else words
    found = plain(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    runs = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc, len(found), *top, hashlib.sha256(runs).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_on_short_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {tuple(x) for x in op13_seed_extend_runs(spark, str(tmp_path)).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert found == {expected(x[0], x[1], planted_runs) for x in rows} and len(rows) > 50
    assert any(x[1] for x in found) and any(not x[1] for x in found)


def test_odd_rows(spark):
    rows = [
        (1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "a b " * 9, 0), (4, "x" * 50, 0), (4, "x" * 50, 0),
        (5, "a b " * 12, 1), (6, "\x1cq " * 12, 1), (7, "é ß " * 40 + "end", 2), (-8, "A a " * 6, 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    found = sorted((tuple(x) for x in r.run_report(docs).collect()), key=repr)
    assert found == sorted((expected(d, t) for d, t, _ in rows), key=repr)
    whole = {x["doc_id"]: x for x in r.document_runs(docs).collect()}
    assert whole[7]["collapsed"] == "é ß end" and tuple(whole[7]["runs"][0]) == (0, 80, 2)
    assert whole[1]["runs"] == [] and whole[1]["collapsed"] == ""
    assert r.run_report(docs.limit(0)).collect() == [] and r.document_runs(docs.limit(0)).collect() == []
