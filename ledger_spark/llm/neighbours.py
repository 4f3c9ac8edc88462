"""Nearest neighbours through learned partitions.

A bounded sample of the vectors gives a nearest-neighbour graph, which recursive
spectral bisection cuts into parts of equal size. A small classifier learns to
predict, from a vector alone, in which parts its neighbours are. Every vector is
indexed under its ``HOMES`` most probable parts; a query searches the most
probable parts until the sample says that enough of its neighbours are there, and
goes on while they may hold too few vectors. All candidates found are ranked by
their exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.staging import stage

# Vectors that the index is fitted on.
SAMPLE = 4096
# Sampled vectors of a part at least, and the most parts.
LEAST, MAX_PARTS = 48, 256
# Parts that a vector is indexed under.
HOMES = 2
# Candidates and queries that one search call takes on average.
BLOCK, QUERIES = 2048, 4096
GRAPH = 10
HIDDEN, STEPS, RATE = 48, 120, 0.01
# Share of the sample's held-back neighbours that probing has to reach.
RECALL = 0.94


@dataclass
class Router:
    """The classifier, and how many parts a query searches."""

    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None
    parts: int
    probes: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.zeros((len(vectors), 1))
        w, a, v, b = self.layers
        return np.maximum(_unit(vectors) @ w + a, 0) @ v + b

    def ranked(self, vectors: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")[:, :n]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row."""
    squares = (vectors**2).sum(1)
    out = []
    for at in range(0, len(vectors), 512):
        part = squares[at : at + 512, None] + squares - 2 * vectors[at : at + 512] @ vectors.T
        part[np.arange(len(part)), at + np.arange(len(part))] = np.inf
        out.append(np.argpartition(part, k, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """Cut a graph into ``parts`` (a power of two) parts of equal size with few edges between them.

    Each bisection orders its nodes by the slowest-mixing direction of a random
    walk within them and cuts at the median.
    """
    rng = np.random.default_rng(seed)
    label = np.zeros(len(graph), np.int64)
    count = 1
    while count < parts:
        for part in range(count):
            nodes = np.flatnonzero(label == part)
            place = np.full(len(graph), -1)
            place[nodes] = np.arange(len(nodes))
            near = place[graph[nodes]]
            rows, ends = np.nonzero(near >= 0)
            ends = near[rows, ends]
            a, b = np.r_[rows, ends], np.r_[ends, rows]
            degree = np.bincount(a, minlength=len(nodes)) + 1.0
            x = rng.normal(size=len(nodes))
            for _ in range(60):
                x -= (x * degree).sum() / degree.sum()
                x = (x + (x + np.bincount(a, x[b], len(nodes))) / degree) / 2
                x /= np.linalg.norm(x) + 1e-300
            upper = np.argsort(x, kind="stable")[len(nodes) // 2 :]
            label[nodes[upper]] = count + part
        count *= 2
    return label


def fit(sample: np.ndarray, parts: int) -> Router:
    """Train on three quarters of the sample and set the probes on the rest."""
    k = min(GRAPH, len(sample) - 1)
    if parts < 2 or k < 1:
        return Router(None, 1, 1)
    graph = neighbour_graph(sample, k)
    label = balanced_parts(graph, parts)
    around = np.zeros((len(sample), parts))
    for column in graph.T:
        around[np.arange(len(sample)), label[column]] += 1
    around[np.arange(len(sample)), label] += 1
    around /= around.sum(1, keepdims=True)

    rng = np.random.default_rng(7)
    train = np.arange(len(sample)) % 4 != 0
    x, y = _unit(sample[train]), around[train]
    layers = [
        rng.normal(size=(x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]) * 3,
        np.zeros(HIDDEN),
        rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN),
        np.zeros(parts),
    ]
    speed, power = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, STEPS + 1):
        w, a, v, b = layers
        inner = np.maximum(x @ w + a, 0)
        z = inner @ v + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        out = (p - y) / len(x)
        back = (out @ v.T) * (inner > 0)
        for i, slope in enumerate((x.T @ back, back.sum(0), inner.T @ out, out.sum(0))):
            slope = slope + 1e-4 * layers[i]
            speed[i] = 0.9 * speed[i] + 0.1 * slope
            power[i] = 0.99 * power[i] + 0.01 * slope**2
            layers[i] = layers[i] - RATE * (speed[i] / (1 - 0.9**step)) / (np.sqrt(power[i] / (1 - 0.99**step)) + 1e-9)
    router = Router(tuple(layers), parts, parts)
    homes = router.ranked(sample, HOMES)
    held = np.flatnonzero(~train)
    order = router.ranked(sample[held], parts)
    place = np.argsort(order, axis=1)
    needed = np.min([np.take_along_axis(place, homes[graph[held], h], axis=1) for h in range(HOMES)], axis=0)
    for probes in range(1, parts + 1):
        if (needed < probes).mean() >= RECALL:
            router.probes = probes
            break
    return router


def usable(vector: Column, dim: int) -> Column:
    """A vector of ``dim`` finite components, not all zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & whole & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def parts_for(sampled: int) -> int:
    """Number of parts, a power of two, so that each holds ``LEAST`` sampled vectors or more."""
    parts = 1
    while 2 * parts * LEAST <= sampled and parts < MAX_PARTS:
        parts *= 2
    return parts


def probe_counts(ordered: np.ndarray, probes: int, enough: int) -> np.ndarray:
    """Parts that each query searches, given the numbers of ids in its parts, most probable first.

    An id is in at most ``HOMES`` parts per row, so parts with ``HOMES * enough``
    entries hold ``enough`` different ids.
    """
    short = (np.cumsum(ordered, axis=1) < HOMES * enough).sum(1) + 1
    return np.clip(short, probes, ordered.shape[1])


def _routed(router: Router, dim: int, sizes: np.ndarray | None = None, enough: int = 0):
    """The homes of each vector, or the parts that it searches if ``sizes`` of the parts are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = router.ranked(_matrix(batch.column(1), dim), HOMES if sizes is None else router.parts)
            counts = np.full(len(parts), parts.shape[1])
            if sizes is not None:
                counts = probe_counts(sizes[parts], router.probes, enough)
            chosen = parts[np.arange(parts.shape[1]) < counts[:, None]].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(chosen))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "vector": batch.column(1), "parts": lists})

    return run


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """For each query the ``k`` nearest other ids: query number, row numbers, distances."""
    squares = (vectors**2).sum(1)
    single = len(np.unique(ids)) == len(ids)
    for number, (query, own) in enumerate(zip(queries, query_ids)):
        if single and len(ids) > k + 1:
            rough = squares - 2 * (vectors @ query)
            rough[ids == own] = np.inf
            bound = np.partition(rough, k - 1)[k - 1]
            slack = 1e-9 * (abs(bound) + squares.max() + query @ query)
            rows = np.flatnonzero(rough <= bound + slack)
        else:
            rows = np.arange(len(ids))
        rows = rows[ids[rows] != own]
        exact = np.sqrt(((vectors[rows] - query) ** 2).sum(1))
        best = np.lexsort((ids[rows], exact))
        if not single:
            # the nearest row of each id, in the order of their distance
            best = best[np.sort(np.unique(ids[rows][best], return_index=True)[1])]
        best = best[:k]
        yield number, rows[best], exact[best]


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if candidates["id"].duplicated().any():
            same = pd.DataFrame({"id": candidates["id"], "vector": candidates["vector"].map(bytes)})
            candidates = candidates[~same.duplicated()]
        if len(candidates) and len(queries):
            vectors = np.stack(candidates["vector"].to_numpy()).astype(np.float64)
            ids, wanted = candidates["id"].to_numpy(), queries["id"].to_numpy()
            asked = np.stack(queries["vector"].to_numpy()).astype(np.float64)
            for number, rows, exact in nearest(asked, wanted, vectors, ids, k):
                out["query_id"] += [wanted[number]] * len(rows)
                out["vec_id"] += ids[rows].tolist()
                out["score"] += exact.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows found for every query row, by Euclidean distance.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored.
    One row per query and neighbour: ``query_id``, ``rank`` from 1, ``vec_id``,
    ``score`` (the distance), nearest first, ties to the smaller vec_id. A row
    is no candidate of a query with its own vec_id. Rows without id, vectors that
    are null, zero, not finite, or of another length than most take no part.
    Repeated rows count once; of different vectors under one vec_id the nearest
    counts. An empty table gives no rows. A query finds ``k`` neighbours whenever
    there are as many: it searches further parts while those chosen may hold too
    few ids. Equal vectors share their parts, whose blocks of bounded size are
    searched in separate tasks. The index is fitted on ``SAMPLE`` vectors and
    holds every row.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        is_query.alias("query"),
    )
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = lengths["dim"] if lengths else 0
    rows = rows.filter(usable(F.col("vector"), dim))
    sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    parts = parts_for(len(sample))
    router = fit(np.array([r["vector"] for r in sample], np.float64).reshape(-1, max(dim, 1)), parts)

    schema = "id bigint, vector array<double>, parts array<int>"
    placed = rows.select("id", "vector").mapInArrow(_routed(router, dim), schema)
    placed = stage(placed.select("id", "vector", F.explode("parts").alias("part")), "index")
    # at most MAX_PARTS rows: how many blocks of candidates a part has, and how many different ids
    sizes = placed.groupBy("part").agg(
        F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.countDistinct("id").alias("ids")
    )
    sizes = stage(sizes, "sizes")
    held = np.zeros(router.parts, np.int64)
    for r in sizes.collect():
        held[r["part"]] = r["ids"]
    asked = rows.filter("query").select("id", "vector").mapInArrow(_routed(router, dim, held, k + 1), schema)
    asked = stage(asked.select("id", "vector", F.explode("parts").alias("part")), "queries")

    turns = asked.groupBy("part").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("turns"))
    plan = stage(sizes.join(turns, "part"), "plan")
    left = placed.join(F.broadcast(plan), "part")
    left = left.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    right = asked.join(F.broadcast(plan), "part")
    right = right.withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["part", "block", "turn"]
    found = (
        left.select(*names, "id", "vector")
        .groupBy(*names)
        .cogroup(right.select(*names, "id", "vector").groupBy(*names))
        .applyInPandas(_search(k), "query_id bigint, vec_id bigint, score double")
    )
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
