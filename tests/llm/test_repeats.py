"""Removal of repeated strings against a plain version."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa

from ledger_spark.llm import repeats
from ledger_spark.llm.repeats import repeat_report

L = 100


def plain(rows):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - L + 1):
            s = data[i : i + L]
            if s in seen:
                gone[i : i + L] = b"\1" * L
            seen.add(s)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(docs):
    return sorted((tuple(r) for r in repeat_report(docs).collect()), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got(docs) == want and sum(r[2] for r in want) > 1000


def test_edits_periods_and_edges(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 7)))
    base = " ".join(word() for _ in range(120))
    rows = []
    for i in range(150):
        kind = rng.randrange(6)
        if kind == 0:
            text = base[rng.randrange(60) :][: rng.randrange(90, 400)]
        elif kind == 1:
            text = list(base)
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(len(text))] = rng.choice("xyz")
            text = "".join(text)
        elif kind == 2:
            text = word() * rng.randrange(1, 120)
        elif kind == 3:
            text = " ".join(word() for _ in range(20)) + base[:rng.randrange(99, 140)] + " ".join(word() for _ in range(20))
        elif kind == 4:
            text = base + word() + base
        else:
            text = rng.choice(["", "a" * 99, "a" * 100, "a" * 101, "ab" * 300, base])
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(docs) == plain(rows)


def test_odd_rows(spark):
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(3000))
    rows = [(2, text), (2, text), (1, None), (None, text[500:900]), (None, None), (7, ""), (-3, text[:150]), (9, text * 3), (9, "z" * 20_000)]
    docs = spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id bigint, text string, kept string")
    assert got(docs) == plain(rows)
    assert repeat_report(docs.limit(0)).collect() == []


def test_slabs(spark, monkeypatch):
    from ledger_spark.llm import repeats

    monkeypatch.setattr(repeats, "SLAB", 500)
    text = "".join(random.Random(4).choice("abc") for _ in range(4000))
    whole = {(int(h), p) for h, a, b in zip(*repeats.anchors(text.encode())) for p in range(a, b + 1)}
    monkeypatch.setattr(repeats, "SLAB", 1 << 22)
    assert whole == {(int(h), p) for h, a, b in zip(*repeats.anchors(text.encode())) for p in range(a, b + 1)}


def test_line_with_very_many_surroundings(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    line, ends = some(90), [some(15) for _ in range(3000)]
    rows = [(i, some(60) + line + rng.choice(ends) + some(40)) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert got(docs) == plain(rows)


def test_hot_anchor_is_not_held_in_one_task():
    rng = random.Random(4)
    count, size = 40_000, 140
    parts = [rng.randbytes(20) + b"x" * 100 + rng.randbytes(size - 120) for _ in range(count)]
    read = 0

    def batches():
        nonlocal read
        for at in range(0, count, 1000):
            read = at + 1000
            here = parts[at : at + 1000]
            columns = [[7] * 1000, list(range(at, at + 1000)), [0] * 1000, [size - 100] * 1000, here]
            yield pa.RecordBatch.from_pydict(dict(zip(repeats._SCHEMA.names, columns)), repeats._SCHEMA)

    seen = 0
    for out in repeats._decide(batches()):
        seen += out.num_rows
        # what was read and not yet given on is bounded
        assert (read - seen / 41) * size < 2 * repeats.HOT_BYTES
    assert seen == 41 * count


def test_short_texts_are_searched_together():
    """Few batches for many short texts, and the anchors that each text has alone."""
    rng = random.Random(6)
    some = ["".join(rng.choices("abé ", k=rng.choice([0, 60, 99, 100, 101, 700]))).encode() for _ in range(400)] + [b"long " * 70_000, b"end" * 50]
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(7, 7 + len(some))), "text": pa.array([t.decode() for t in some])})
    out = list(repeats._anchor_rows(iter([batch])))
    assert len(out) < 10
    found = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert found == [(h, 7 + i, a) for i, t in enumerate(some) for h, a in zip(*(c.view("i8").tolist() for c in repeats.anchors(t)[:2]))]


def test_neighbouring_repeats_are_one_row():
    """A repeated passage leaves as one stretch, from contexts seen before and from the suffix order."""
    text = "".join(random.Random(7).choices("abcdefgh ", k=3000))
    starts = repeats.anchors(text.encode())[1].tolist()
    columns = {"row": [1, 2], "starts": [starts, starts], "text": [text, "?" + text[200:]]}
    starts = repeats.anchors(columns["text"][1].encode())[1].tolist()
    columns["starts"][1] = starts
    rows = pa.Table.from_batches(repeats._contexts(iter([pa.RecordBatch.from_pydict(columns)]))).to_pylist()
    known = [r for r in rows if r["bytes"] is None]
    assert [r["row"] for r in known] == [2] and known[0]["last"] == 2700 + 1
    a, b = ("".join(random.Random(seed).choices("xyz", k=300)).encode() for seed in (1, 2))
    contexts = [a, b, b"!" + a[10:250] + b"!" + b[:120], a[:99]]
    assert [tuple(c.tolist()) for c in repeats.repeated_stretches(contexts)] == [(2, 2), (1, 242), (241, 362)]


def test_equal_contexts_of_many_batches():
    """Equal contexts are found within a batch and across batches of one anchor."""
    rng = random.Random(8)
    parts = [rng.randbytes(30) + b"y" * 90 + rng.randbytes(30) for _ in range(5)]
    rows = sorted((rng.randrange(3), i, rng.choice([*parts, None])) for i in range(500))
    rows = [(anchor, i, 0, 50, data and bytes([anchor]) + data[1:]) for anchor, i, data in sorted(rows, key=lambda r: r[:2])]
    for size in (1, 2, 7, 500):
        batches = [pa.RecordBatch.from_pydict(dict(zip(repeats._SCHEMA.names, zip(*rows[at : at + size]))), repeats._SCHEMA) for at in range(0, 500, size)]
        got = {(r["row"], p) for b in repeats._decide(iter(batches)) for r in b.to_pylist() for p in range(r["start"], r["end"] - L + 1)}
        seen, want = set(), set()
        for anchor, i, _, _, data in rows:
            strings = range(51) if data is None else [p for p in range(51) if (anchor, data[p : p + L]) in seen]
            want |= {(i, p) for p in strings}
            seen |= set() if data is None else {(anchor, data[p : p + L]) for p in range(51)}
        assert got == want
