"""Personal data: base spans against plain patterns, and what voting adds."""

from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from ledger_spark.llm import personal_data as d
from ledger_spark.llm.spans import cleared

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def accepted(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if accepted(kind, m.group())]
    return sorted(out)


def check(rows, got):
    assert len(rows) == len(got)
    want = {}
    for doc, text in rows:
        spans = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        counts = tuple(sum(k == kind for *_, k in spans) for kind in BASE)
        want.setdefault(doc, []).append((counts, hashlib.sha256(joined.encode()).hexdigest(), joined))
    for r in got:
        options = want[r["doc_id"]]
        kept = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in BASE)
        assert (tuple(r)[1:5], r["base_sha256"], kept) in options, (r, options)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = d.personal_report(docs).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], got)
    assert sum(sum(tuple(r)[1:5]) for r in got) > 20


def test_random_strings(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        alphabet = rng.choice(["ab@.-_", "12.", "0123456789 -", "+12 ().-", "a@b.c1+ -_é𝄞%", "45 -+.@x"])
        rows.append((i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))))
    check(rows, d.personal_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (2, "é𝄞 a@b.co 4111 1111 1111 1111"), (None, "1.2.3.4 +1 (555) 234-5678"),
        (3, "1 2 " * 40_000), (4, "a" * 300_000 + "@x.y"), (5, "a@" + "b." * 50_000 + "c"), (6, "1." * 8_000 + "1"),
        (7, "x" * 200_000), (8, "+" + "1-" * 50_000), (9, " ".join(f"u{i}@mail.com" for i in range(2000))),
    ]
    docs = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id bigint, text string, spans string")
    check(rows, d.personal_report(docs).collect())
    assert d.personal_report(docs.limit(0)).collect() == []
    none = spark.createDataFrame([(1, "nothing here")], "doc_id bigint, text string")
    assert d.personal_report(none).collect()[0]["spans"] == ""


def test_voting_adds_and_rejects(spark):
    rows = [(i, f"Please call my phone {200 + i % 700}-{234 + i % 500}-{1000 + i} or mail u{i}@mail.com today.") for i in range(300)]
    rows += [(1000 + i, f"see invoice #000.{100 + i % 90}.{1000 + i}9 page") for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in d.personal_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum("phone_local" in v for k, v in got.items() if k < 1000) > 290
    assert not any("phone_local" in v for k, v in got.items() if k >= 1000)


def test_em_finds_the_reliable_labelers():
    rng = random.Random(2)
    counted = {}
    for _ in range(6000):
        y = rng.random() < 0.6
        vs = tuple((1 if y == (rng.random() < q) else -1) if rng.random() < 0.9 else 0 for q in (0.95, 0.9, 0.85, 0.55, 0.5, 0.8))
        counted[vs, y] = counted.get((vs, y), 0) + 1
    patterns = {}
    for (vs, y), c in counted.items():
        patterns[vs] = patterns.get(vs, 0) + c
    model = d.estimate([{"kind": "email", "size": 1, "count": c, **dict(zip(d.LABELERS, vs))} for vs, c in sorted(patterns.items())])
    hit = [model.reliability[n, 1][0] for n in d.LABELERS]
    assert hit[0] > hit[5] > hit[3] and abs(hit[0] - 0.95) < 0.05


def test_many_matches_in_one_text(spark):
    rows = [
        (1, " ".join(f"u{i}@mail.com" for i in range(100_000))),
        (2, " ".join(f"call 212-555-{1000 + i % 9000} or 10.0.{i % 256}.1" for i in range(30_000))),
    ]
    started = time.perf_counter()
    check(rows, d.personal_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert time.perf_counter() - started < 60


def test_spans_that_overlap_none(spark):
    rng = random.Random(8)
    made = lambda n: [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(400) for _ in range(n))]
    rows = [(i, made(rng.choice([0, 1, 5, 300])), made(rng.choice([0, 1, 5, 60, 700]))) for i in range(60)]
    kind = "array<struct<start:int,end:int>>"
    docs = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}")
    got = docs.select("i", cleared(F.col("a"), F.col("b")).alias("c")).collect()
    for i, kept in got:
        _, a, b = rows[i]
        assert sorted(map(tuple, kept)) == sorted(s for s in a if not any(x < s[1] and s[0] < y for x, y in b))
