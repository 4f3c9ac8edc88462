"""The line field: exact marginals, held-out accuracy, odd rows."""

from __future__ import annotations

import itertools

import numpy as np

from ledger_spark.llm import line_quality as q

FOLDER = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([4, 3, 3, 1])
    unary, ties = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    good, total, pairs = q.forward_backward(unary, sizes, ties)
    want_pairs, at = np.zeros((2, 2)), 0
    for size, log_total in zip(sizes, total):
        u = unary[at : at + size]
        weight = {}
        for y in itertools.product((0, 1), repeat=int(size)):
            weight[y] = np.exp(sum(u[i] * y[i] for i in range(size)) + sum(ties[a, b] for a, b in zip(y, y[1:])))
        z = sum(weight.values())
        assert np.isclose(np.log(z), log_total)
        for i in range(size):
            assert np.isclose(sum(w for y, w in weight.items() if y[i]) / z, good[at + i])
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
        at += size
    assert np.allclose(pairs, want_pairs)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    order = np.mean([a > b for a in good for b in bad])
    assert right > 0.9 and order > 0.95


def test_odd_rows(spark):
    long = "\n".join(["The words of a line.", "A B C!! D!!"] * 20_000)
    rows = [(1, None, 0.5), (2, "", 0.1), (2, "x", 0.1), (None, "\n\n", None), (5, long, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (5, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = q.quality_scores(docs, labels).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == [-1, 1, 2, 2, 5]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert q.quality_scores(docs, labels.limit(0)).filter("score = 1").count() == 5
    assert q.quality_scores(docs.limit(0), labels).collect() == []
    kept = q.good_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 5


def test_training_takes_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "fit", lambda lines, labels: seen.append((sorted(len(own) for own, _ in lines), labels)))
    texts = ["a line\n" * (i % 7) + "b" for i in range(300)] + ["c\n" * 999]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    used = [r["doc_id"] for r in docs.filter(~q.held_out(docs["doc_id"])).collect()]
    q.train(docs, labels)
    assert seen[-1][0] == sorted(texts[i].count("\n") + 1 for i in used)
    q.train(docs.union(docs).union(docs), labels)
    assert seen[-1][0] == seen[-2][0]
    monkeypatch.setattr(q, "TRAIN_LINES", 100)
    q.train(docs, labels)
    assert 80 < sum(seen[-1][0]) <= 100 and len(seen[-1][1]) == len(seen[-1][0])


def test_long_texts_are_trained_on_in_chains():
    good, bad = q.line_features(b"Some words of a line.\n" * 500), q.line_features(b"!! A9 !! A9\n" * 500)
    model = q.fit([good, bad] * 5, np.array([1.0, 0.0] * 5))
    a, b = model.scores([b"Some words of a line.\n" * 500, b"!! A9 !! A9\n" * 500])
    assert a > 0.8 and b < 0.2
