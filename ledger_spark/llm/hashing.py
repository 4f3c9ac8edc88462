"""Hashes of words and word sequences, computed on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Odd 64-bit multipliers; each position of a word sequence takes its own.
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)

# Bytes of text hashed at once, and the longest word that is hashed in lanes of 8 bytes.
HASH_BYTES = 1 << 20
LANE_BYTES = 64

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
# The first bytes of a lane, by their number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> _SHIFT)) * _MIX
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> _SHIFT)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes, in text order."""
    count = len(words) - n + 1
    total = np.zeros(max(count, 0), np.uint64)
    factor = 1
    for i in range(n if count > 0 else 0):
        factor = (factor * int(_MIX) + 2 * i) % (1 << 64)
        total = total * _ODD + words[i : i + count] * np.uint64(factor)
    return mix(total)


def word_hashes(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts in order, and each text's number of words.

    A-Z is lower-cased and words end at ASCII white space. A word is hashed 8 bytes
    at a time, all words at once; those above ``LANE_BYTES`` are hashed each.
    """
    joined = b" " + b" ".join(many).lower() + b" " * 8
    data = np.frombuffer(joined, np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, size = edges[::2], edges[1::2] - edges[::2]
    lanes = np.ndarray(len(data) - 7, "<u8", joined, strides=(1,))
    words = size.astype(np.uint64) * _ODD
    for at in range(0, LANE_BYTES, 8):
        live = np.flatnonzero(size > at)
        if not len(live):
            break
        lane = lanes[starts[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]
        words[live] = mix(words[live] ^ lane)
    for i in np.flatnonzero(size > LANE_BYTES).tolist():
        words[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : starts[i] + size[i]])
    ends = np.cumsum([len(text) + 1 for text in many])
    return words, np.diff(np.searchsorted(starts, ends + 1), prepend=0)


def sort_parts(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sort each part of ``values`` in place; part i lies between bounds i and i + 1."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()


def _sets(many: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = word_hashes(many)
    lengths = np.where(counts >= n, counts - n + 1, counts > 0)
    bounds = np.r_[0, np.cumsum(lengths)]
    first = np.cumsum(counts) - counts
    found = np.zeros(bounds[-1], np.uint64)
    whole = np.repeat(counts >= n, lengths)
    at = np.arange(len(found)) + np.repeat(first - bounds[:-1], lengths)
    found[whole] = windows(words, n)[at[whole]] + np.uint64(n)
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        run = words[(first[short, None] + np.arange(k)).ravel()]
        found[bounds[short]] = windows(run, k)[::k] + np.uint64(k)
    sort_parts(found, bounds)
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[bounds[:-1][lengths > 0]] = True
    return found[new], np.r_[0, np.cumsum(new)][bounds]


def shingle_sets(many: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashes of the ``n``-word sequences of each text, ascending within a text.

    Gives the hashes of some texts after another and their bounds (part i lies
    between bounds i and i + 1), for about ``HASH_BYTES`` of text at a time. Words
    are those of ``word_hashes``; a text of fewer words is one sequence.
    """
    start = size = 0
    for at, text in enumerate(many):
        size += len(text)
        if size >= HASH_BYTES or at == len(many) - 1:
            yield _sets(many[start : at + 1], n)
            start, size = at + 1, 0


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each value of an Arrow string column."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py()
