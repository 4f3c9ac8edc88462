"""Sets of word sequences of many texts at once against sets of tuples."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from ledger_spark.llm import hashing as h


def plain(text: bytes, n: int) -> frozenset:
    words = text.lower().split()
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


@pytest.mark.parametrize("n", [1, 2, 5])
def test_sets_of_odd_texts(monkeypatch, n):
    monkeypatch.setattr(h, "HASH_BYTES", 3000)
    rng = random.Random(n)
    parts = [b"a", b"B", b" ", b"\n", b"\x0b", b"\x00", b"\xc3\xa9", b"\xc2\xa0", b"x" * 8, b"y" * 70, b"Y" * 71, b"\x1c", b"  ", b"c d"]
    many = [b"".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(1500)]
    got = [found[a:b] for found, bounds in h.shingle_sets(many, n) for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(g) for g in got] == [len(plain(t, n)) for t in many]
    assert all((g[1:] > g[:-1]).all() for g in got)
    by_set: dict = {}
    for text, found in zip(many, got):
        assert by_set.setdefault(plain(text, n), found.tobytes()) == found.tobytes()
    assert len(set(by_set.values())) == len(by_set)


def test_no_texts():
    assert list(h.shingle_sets([], 4)) == []
    [(found, bounds)] = h.shingle_sets([b"", b" \n"], 4)
    assert found.dtype == np.uint64 and not len(found) and bounds.tolist() == [0, 0, 0]


def test_words_are_not_hashed_one_by_one():
    rng = random.Random(8)
    many = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(400)).encode() for _ in range(500)]

    def seconds(work) -> float:
        best = []
        for _ in range(5):
            began = time.process_time()
            work()
            best.append(time.process_time() - began)
        return min(best)

    split = seconds(lambda: [len(set(text.lower().split())) for text in many])
    assert seconds(lambda: list(h.shingle_sets(many, 5))) < 5 * split
