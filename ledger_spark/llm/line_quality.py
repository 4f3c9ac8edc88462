"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence are its own features and those of
the lines before and after it; neighbouring labels are tied by a transition
score. Forward-backward gives each line's probability of being good, and the
mean weighted by line length, calibrated on the training rows, is the document's
score.

The model is fitted on the driver from a bounded sample of whole labelled
documents (``TRAIN_DOCS`` documents with ``TRAIN_LINES`` lines in all). Scoring
reads every line of every document, in one pass without a shuffle.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.hashing import texts
from ledger_spark.staging import stage

# Bounds of the training sample: whole documents, and the lines that all of them hold.
TRAIN_DOCS = 3_000
TRAIN_LINES = 300_000
# Lines of a training chain; longer documents are trained on as several chains.
CHAIN = 48
STEPS = 120
RATE = 0.15
PENALTY = 1e-3
# Score from which a document counts as good.
THRESHOLD = 0.3

_KINDS = 9
_TABLE = np.full(256, 7, np.uint8)
for _kind, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:?'\"()-", b"!")
):
    _TABLE[list(_bytes)] = _kind
_TABLE[[c for c in range(33, 127) if _TABLE[c] == 7]] = 6
_TABLE[[c for c in range(32) if c != 9] + [127]] = 8
OWN = 13
WIDTH = 3 * OWN + 3


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Own features of each line of a text, and its length in bytes plus one."""
    data = np.frombuffer(text + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = (ends - starts).astype(np.float32)
    kinds = _TABLE[data]
    counts = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int32) for k in range(_KINDS - 1)], 1)
    share = counts / np.maximum(length, 1)[:, None]
    lines = text.split(b"\n")
    repeated, distinct, words = np.zeros((3, len(lines)), np.float32)
    for i, line in enumerate(lines):
        found = line.split()
        words[i] = k = len(found)
        if k > 1:
            repeated[i] = sum(map(operator.eq, found, found[1:])) / (k - 1)
            distinct[i] = len(set(found)) / k
    own = np.empty((len(lines), OWN), np.float32)
    own[:, :8] = share
    own[:, 1] = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    own[:, 8] = repeated
    own[:, 9] = distinct
    own[:, 10] = np.minimum(length / np.maximum(words, 1) / 10, 3)
    own[:, 11] = np.log1p(length) / 5
    own[:, 12] = words <= 2
    return own, length + 1


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of each line next to those of the line before and after, for one text."""
    full = np.zeros((len(own), WIDTH), np.float32)
    full[:, :OWN] = own
    full[1:, OWN : 2 * OWN] = own[:-1]
    full[:-1, 2 * OWN : 3 * OWN] = own[1:]
    full[:, -3] = 1
    full[0, -2] = 1
    full[-1, -1] = 1
    return full


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))


def forward_backward(unary: np.ndarray, sizes: np.ndarray, ties: np.ndarray):
    """Marginals of many chains at once.

    ``unary`` holds each line's log-odds of being good, chain after chain, the
    chains sorted by falling ``sizes``. Gives P(good) per line, the log partition
    per chain and the expected count of each pair of neighbouring labels.
    """
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    score = np.zeros((len(unary), 2))
    score[:, 1] = unary
    ahead = score.copy()
    steps = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(1, steps)]
    for t, n in enumerate(active, 1):
        at = starts[:n] + t
        ahead[at] += _logsum(ahead[at - 1][:, :, None] + ties, 1)
    total = _logsum(ahead[starts + sizes - 1], 1) if len(sizes) else np.zeros(0)
    behind = np.zeros_like(score)
    pairs = np.zeros((2, 2))
    for t, n in zip(range(steps - 1, 0, -1), active[::-1]):
        at = starts[:n] + t
        onward = score[at] + behind[at]
        joint = ahead[at - 1][:, :, None] + ties + onward[:, None, :] - total[:n, None, None]
        pairs += np.exp(joint).sum(0)
        behind[at - 1] = _logsum(ties + onward[:, None, :], 2)
    good = np.exp(ahead[:, 1] + behind[:, 1] - np.repeat(total, sizes))
    return np.minimum(good, 1.0), total, pairs


@dataclass
class Model:
    """Weights of the field and of the final calibration; ``weights`` None: constant score."""

    weights: np.ndarray | None
    ties: np.ndarray
    slope: float
    offset: float

    def scores(self, documents: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(documents), self.offset)
        return _calibrated(self, self.quality([line_features(t) for t in documents]))

    def quality(self, lines: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Mean probability of good lines, weighted by their length."""
        if not lines:
            return np.zeros(0)
        sizes = np.array([len(own) for own, _ in lines])
        order = np.argsort(-sizes, kind="stable")
        unary = np.concatenate([with_neighbours(lines[i][0]) @ self.weights for i in order])
        good, _, _ = forward_backward(unary, sizes[order], self.ties)
        length = np.concatenate([lines[i][1] for i in order]).astype(float)
        starts = np.r_[0, np.cumsum(sizes[order])[:-1]]
        mean = np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)
        out = np.empty(len(lines))
        out[order] = mean
        return out


def _calibrated(model: Model, quality: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * quality + model.offset, -30, 30)))


def fit(lines: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Train on texts whose lines start with their document's label.

    After half the steps the lines of bad documents that look good with more
    than even odds are taken as good, because such documents also hold ordinary
    lines. A long text is trained on in chains of ``CHAIN`` lines, which leaves
    out only the ties between two chains; the calibration sees each text as one.
    With labels of one kind only, every score is that label; without labels it
    is 1.
    """
    ties = np.zeros((2, 2))
    if len(set(labels.tolist())) < 2:
        return Model(None, ties, 0.0, float(labels[0]) if len(labels) else 1.0)
    chains = []
    for (own, _), label in zip(lines, labels):
        full = with_neighbours(own)
        chains += [(full[at : at + CHAIN], label) for at in range(0, len(full), CHAIN)]
    chains.sort(key=lambda chain: -len(chain[0]))
    sizes = np.array([len(full) for full, _ in chains])
    x = np.concatenate([full for full, _ in chains])
    bad = np.repeat([label == 0 for _, label in chains], sizes)
    y = 1.0 - bad
    inner = np.ones(len(y), bool)
    inner[np.cumsum(sizes) - 1] = False
    inner = np.flatnonzero(inner)

    weights = np.zeros(WIDTH)
    both = np.r_[weights, ties.ravel()]
    speed, power = np.zeros_like(both), np.zeros_like(both)
    for step in range(1, STEPS + 1):
        weights, ties = both[:WIDTH], both[WIDTH:].reshape(2, 2)
        good, _, pairs = forward_backward(x @ weights, sizes, ties)
        if step == STEPS // 2:
            y = np.where(bad & (good < 0.5), 0.0, 1.0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
        slope = np.r_[x.T @ (y - good), (seen - pairs).ravel()] / len(y) - PENALTY * both
        speed = 0.9 * speed + 0.1 * slope
        power = 0.99 * power + 0.01 * slope**2
        both = both + RATE * (speed / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
    model = Model(both[:WIDTH].astype(np.float32), both[WIDTH:].reshape(2, 2), 0.0, 0.0)

    quality = model.quality(lines)
    design = np.stack([quality, np.ones_like(quality)], 1)
    at = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        bend = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-2])
        at = at + np.linalg.solve(bend, design.T @ (labels - p) - 1e-2 * at)
    model.slope, model.offset = float(at[0]), float(at[1])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, length = [], []
        for text in texts(batch.column(1)):
            features, sizes = line_features(text or b"")
            own.append(features.tobytes())
            length.append(sizes.tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "quality": batch.column(0),
                "own": pa.array(own, pa.binary()),
                "length": pa.array(length, pa.binary()),
            }
        )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on whole labelled documents, taken in the order of the hash of their id.

    At most ``TRAIN_DOCS`` documents, and of these as many as hold ``TRAIN_LINES``
    lines together. Of several rows with one id the smallest text is taken.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    usable = usable.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = stage(rows.withColumn("lines", breaks + 1).withColumn("turn", F.xxhash64("doc_id")), "training")
    # one number per sampled document
    chosen, left = [], TRAIN_LINES
    for doc, size in rows.orderBy("turn", "doc_id").select("doc_id", "lines").collect():
        if size <= left:
            chosen.append(doc)
            left -= size
    rows = rows.filter(F.col("doc_id").isin(chosen)).select("quality", "text")
    found = rows.mapInArrow(_training_lines, "quality int, own binary, length binary")
    found = sorted(((r["quality"], bytes(r["own"]), bytes(r["length"])) for r in found.collect()))
    lines = [(np.frombuffer(o, np.float32).reshape(-1, OWN), np.frombuffer(n, np.float32)) for _, o, n in found]
    return fit(lines, np.array([q for q, _, _ in found], float))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id`` and
    ``quality`` (0 or 1; other values are ignored, of several labels of one
    document the lowest counts). One row per input row: ``doc_id``, ``held_out``
    (False without id), ``score`` (0 to 1, higher is better) and ``predicted``
    (1 from 0.3). A null text is scored as an empty one, which is one blank line;
    long texts are scored whole. Repeated rows get the same score each. An empty
    table gives no rows, and without usable labels every score is 1. Other
    columns of ``docs``, whatever their names, are ignored.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t or b"" for t in texts(batch.column(2))])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "held_out": batch.column(1),
                    "score": pa.array(scores, pa.float64()),
                    "predicted": pa.array((scores >= THRESHOLD).astype(np.int32)),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return chosen.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose predicted quality is 1.

    Nulls, empty and long texts, repeated rows and missing labels as in
    ``quality_scores``; an empty table stays empty.
    """
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t or b"" for t in texts(batch.column(at))])
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
