"""Periodic runs of words: stretches that repeat themselves at least once.

A run is a stretch of words with smallest period ``q`` whose length is at least
``max(12, 2 q)`` and that no neighbouring word extends with that period. Words
``q`` apart are equal along a diagonal of lag ``q``, and a run needs
``max(12 - q, q)`` equal pairs in a row. So every run of a lag below 12 holds two
equal 6-grams at that lag, and every run of a lag from ``k`` to ``2 k - 1`` holds
two equal k-grams. The search goes level by level, k = 6, 12, 24, ...: it indexes
the k-grams, takes the pairs of occurrences whose lag belongs to the level as
seeds, and extends each along its diagonal. A table of the furthest position
covered on each lag keeps a stretch from being extended twice.

A k-gram of period at most k / 2 occurs very often inside a run that an earlier
level has found. Two occurrences inside one such run give nothing new, so these
k-grams are left out of the index; what they can add are stretches around the
border of two runs of one period that touch, and these get seeds of their own.
All other k-grams have occurrences more than k / 2 apart, so a level has a few
pairs for each word at most and the whole search takes about n log n steps,
whatever the text repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.hashing import mix, texts, windows

# Words a run has at least.
LEAST = 12
# Words of the shortest k-gram that every run of a lag below LEAST is sure to repeat.
SEED = LEAST // 2
# Words compared at first when a seed is extended; doubled as long as they agree.
REACH = 64

_JOIN = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]
# position, lag, and the end up to which the diagonal is known to agree
Seed = tuple[int, int, int]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    return np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words))


def _pairs(at: np.ndarray, gram: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and lag of all occurrence pairs with a lag from ``low`` below ``high``.

    ``at`` are the positions ordered by k-gram and then by place, ``gram`` their k-grams.
    """
    starts, lags = [], []
    for further in range(1, len(at)):
        lag = at[further:] - at[:-further]
        near = (gram[further:] == gram[:-further]) & (lag < high)
        if not near.any():
            break
        near &= lag >= low
        starts.append(at[:-further][near])
        lags.append(lag[near])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(lags)


def _extended(words: np.ndarray, seed: Seed, known: int) -> tuple[int, int]:
    """First and last-but-one position of the agreeing stretch of a diagonal around a seed.

    Nothing before ``known`` has to be looked at.
    """
    at, lag, end = seed
    last, step = len(words) - lag, REACH
    while end < last:
        stop = min(end + step, last)
        differ = np.flatnonzero(words[end:stop] != words[end + lag : stop + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, 2 * step
    start, step = at, REACH
    while start > known:
        stop = max(start - step, known)
        differ = np.flatnonzero(words[stop:start] != words[stop + lag : start + lag])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, step = stop, 2 * step
    return start, end


def _is_smallest(block: np.ndarray) -> bool:
    """Whether a block of one period is not itself a shorter block repeated."""
    size = rest = len(block)
    factor = 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            period = size // factor
            if (block[period:] == block[:-period]).all():
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _touching(runs: list[Run], gram: np.ndarray, words: np.ndarray, k: int) -> Iterator[Seed]:
    """Seeds between runs of one period, at most k / 2, the second of which begins where the first ends."""
    chosen = sorted((p, i, i + n) for i, n, p in runs if 2 * p <= k <= n)
    for (p, first, stop), (other, second, end) in zip(chosen, chosen[1:]):
        if p != other or second > stop:
            continue
        places = []
        # the stretch begins with the first run ...
        upto = min(second + p, stop + 1, end - k + 1)
        places += [(first, int(u) + second - first) for u in np.flatnonzero(gram[second:upto] == gram[first])]
        # ... or its partner begins with the second
        for phase in np.flatnonzero(gram[first : min(first + p, stop - k + 1)] == gram[second]):
            places += [(at, second - at) for at in range(first + int(phase), stop - k + 1, p)]
        for at, lag in places:
            if k <= lag < 2 * k and (words[at : at + p] == words[at + lag : at + lag + p]).all():
                yield at, lag, min(stop, end - lag)


def word_runs(words: np.ndarray) -> list[Run]:
    """Start, length and period of every run of a sequence of word numbers, by start, then period."""
    n = len(words)
    found: list[Run] = []
    if n < LEAST:
        return found
    values = mix(words.astype(np.uint64) + np.uint64(1))
    k, low, gram = SEED, 1, windows(values, SEED)
    alive = np.arange(len(gram))
    while True:
        # positions whose k-gram occurs again, by k-gram and place
        order = alive[np.argsort(gram[alive], kind="stable")]
        value = gram[order]
        same = value[1:] == value[:-1]
        if not same.any():
            break
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        order, value = order[again], value[again]
        alive = np.sort(order)
        seeds: list[Seed] = []
        if low > 1:
            inside = np.zeros(n, bool)
            for i, length, p in found:
                if 2 * p <= k <= length:
                    inside[i : i + length - k + 1] = True
            seeds += _touching(found, gram, words, k)
            free = ~inside[order]
            order, value = order[free], value[free]
        at, lag = _pairs(order, value, low, 2 * k)
        if len(at):
            by = np.lexsort((at, lag))
            at, lag = at[by], lag[by]
            first = np.ones(len(at), bool)
            first[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
            seeds += zip(at[first].tolist(), lag[first].tolist(), at[first].tolist())
        covered: dict[int, int] = {}
        for seed in sorted(seeds):
            at, lag, _ = seed
            known = covered.get(lag, 0)
            if at < known:
                continue
            start, end = _extended(words, seed, known)
            covered[lag] = end
            if end - start >= max(LEAST - lag, lag) and _is_smallest(words[start : start + lag]):
                found.append((start, end - start + lag, lag))
        if 4 * k > n:
            break
        gram = mix(gram[:-k] * _JOIN + gram[k:])
        alive = alive[alive < len(gram)]
        k, low = 2 * k, 2 * k
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(count: int, runs: list[Run]) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    steps = np.zeros(count + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def _searched(batches: Iterator[pa.RecordBatch], prepare: Prepare | None):
    """Id, words and runs of each document."""
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            words = (text or b"").split()
            if prepare:
                words = prepare(doc, words)
            yield doc, words, word_runs(numbered(words))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def document_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``runs`` (start, length, period) and ``collapsed`` text of every document.

    Words are separated by the ASCII white space characters; their numbers start at 0.
    ``collapsed`` joins, with one space, the words that no run holds after its
    first period. ``docs`` needs ``doc_id`` and ``text``; other columns are left
    out. A null or empty text has no runs and an empty collapsed text; rows that
    repeat an id are searched each; an empty table gives no rows. A text of any
    length is searched whole, by one task, which needs some 100 bytes for each of
    its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"doc_id": [], "runs": [], "collapsed": []}
            for doc, words, runs in _searched(iter([batch]), None):
                rows["doc_id"].append(doc)
                rows["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                mask = kept_words(len(words), runs)
                rows["collapsed"].append(b" ".join(w for w, kept in zip(words, mask) if kept).decode())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(rows["doc_id"], pa.int64()),
                    "runs": pa.array(rows["runs"], _RUNS),
                    "collapsed": pa.array(rows["collapsed"], pa.string()),
                }
            )

    return _input(docs).mapInArrow(
        run, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )


def _digest(doc: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    if runs:
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        longest = (start, length, period, 1000 * length // period)
        mask = kept_words(len(words), runs)
        words = [w for w, kept in zip(words, mask.tolist()) if kept]
    else:
        longest = (None, None, None, None)
    collapsed = hashlib.sha256(b" ".join(words)).hexdigest()
    return doc, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), collapsed


_DIGEST = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)
_DIGEST_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def run_report(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """Number of runs, the longest run, and digests of all runs and of the collapsed text.

    ``prepare`` may replace the words of a document before the search. Of equally
    long runs the first start counts, then the smallest period; without runs the
    four columns of the longest run are null. Everything else is as in
    ``document_runs``: a null text has no words, whose digests are those of the
    empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(*found) for found in _searched(iter([batch]), prepare)]
            columns = list(zip(*rows)) if rows else [[] for _ in _DIGEST_TYPES]
            names = [part.split()[0] for part in _DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DIGEST_TYPES)], names)

    return _input(docs).mapInArrow(run, _DIGEST)
