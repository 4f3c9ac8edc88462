"""Learned partitions: recall, exact scores, odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledger_spark.llm import neighbours as nn


def brute(rows, k=10, every=100):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), d[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_on_whole_table(spark, monkeypatch):
    monkeypatch.setattr(nn, "SAMPLE", 1024)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    got, want = found(nn.nearest_neighbours(table, F.col("vec_id") % 100 == 0)), brute(rows)
    assert got.keys() == want.keys() and len(rows) > nn.SAMPLE
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))
    exact = dict(rows)
    for q, near in got.items():
        for i, score in near:
            assert abs(score - np.sqrt(((np.array(exact[q], float) - np.array(exact[i], float)) ** 2).sum())) < 1e-12


def test_small_and_odd_tables(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]
    bad = [(500, None), (600, [0.0] * 4), (700, [1.0, None, 0.0, 0.0]), (800, [1.0, float("nan"), 0.0, 0.0]), (900, [float("inf")] * 4), (1000, [1.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame([(i, v, "z") for i, v in good + bad], "vec_id bigint, embedding array<double>, score string")
    got, want = found(nn.nearest_neighbours(table, F.col("vec_id") % 10 == 0)), brute(good, every=10)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert found(nn.nearest_neighbours(table.union(table), F.col("vec_id") % 10 == 0)) == got
    assert found(nn.nearest_neighbours(table.limit(0), F.col("vec_id") % 10 == 0)) == {}
    few = found(nn.nearest_neighbours(table.filter("vec_id < 3"), F.col("vec_id") == 0))
    assert [len(v) for v in few.values()] == [2]


def test_balanced_parts_keep_clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 6
    x = np.concatenate([c + rng.normal(size=(64, 16)) for c in centres])
    label = nn.balanced_parts(nn.neighbour_graph(x, 10), 8)
    assert set(np.bincount(label)) == {64}
    assert np.mean([(label[64 * i : 64 * i + 64] == np.bincount(label[64 * i : 64 * i + 64]).argmax()).mean() for i in range(8)]) > 0.9
    router = nn.fit(x, 8)
    assert router.probes <= 3


def test_registered_query_goes_through_partitions(spark, monkeypatch):
    from ledger_spark.llm.queries import op7_learned_partitions

    fitted, plain = [], nn.fit
    monkeypatch.setattr(nn, "fit", lambda *a: fitted.append(plain(*a)) or fitted[-1])
    for folder, parts in (("sf0.01", 8), ("sf0.1", 32)):
        path = f"/root/testdata/{folder}"
        rows = [(r[0], r[1]) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
        got, want = found(op7_learned_partitions(spark, path)), brute(rows)
        assert fitted[-1].parts == parts and fitted[-1].probes < parts
        assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 9 * len(want)


def test_probing_goes_on_when_parts_hold_too_few_ids(spark, monkeypatch):
    # a few vectors far from the others, and far too few of them to fill a list
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) * 0.1 + np.eye(8)[0] * 5).tolist()) for i in range(600)]
    rows += [(1000 + i, (rng.normal(size=8) * 0.1 - np.eye(8)[0] * 5).tolist()) for i in range(4)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(nn, "RECALL", 0.0)
    got = found(nn.nearest_neighbours(table, F.col("vec_id") % 200 == 0))
    assert set(got) == {0, 200, 400, 1000} and all(len(v) == 10 for v in got.values())
    assert (nn.probe_counts(np.array([[5, 0, 30, 9], [40, 0, 0, 0]]), 1, 11) == [3, 1]).all()


def test_many_vectors_under_one_id(spark):
    rng = np.random.default_rng(11)
    rows = [(5, rng.normal(size=4).tolist()) for _ in range(400)] + [(100 + i, rng.normal(size=4).tolist()) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(nn.nearest_neighbours(table, F.col("vec_id") == 100))
    assert len(got[100]) == 10 and len({i for i, _ in got[100]}) == 10
