"""Encoding with a sentence-piece model that keeps every piece's place in the text.

The model's normalisation is done here: at each place the longest entry of its
compiled character map wins, else one character stays as it is; blanks are
handled as the model asks. With the normalised text goes its alignment, the byte
of the original text that each byte came from. The library then segments the
normalised text by a copy of the model whose own normalisation is switched off,
and the alignment projects each piece back to the bytes it stands for. Decoding
is the library's.

The compiled map is a double-array trie whose leaves point at replacement
strings; it is walked as it lies in the model file.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.hashing import texts

# Characters of text encoded at once.
SLICE = 1_000_000

# Field numbers of the model file, piece types, and the blank's sign.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE_TEXT, _PIECE_TYPE = 1, 3
_CHARSMAP, _DUMMY, _EXTRA, _ESCAPE = 2, 3, 4, 5
_AS_SUFFIX = 24
_UNKNOWN, _CONTROL, _USER_DEFINED, _BYTE = 2, 3, 4, 6
_BLANK = "▁".encode()

_VARINT, _BYTES = 0, 2


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message in the wire format of the model file."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == _VARINT:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if tag & 7 == _BYTES else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _coded(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _coded(number << 3 | _VARINT) + _coded(value)
    return _coded(number << 3 | _BYTES) + _coded(len(value)) + value


class CharMap:
    """A compiled character map: bytes to bytes, the longest entry at a place counts."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        self.starts = bytes(b for b in range(256) if self.units and self._child(self._base(0), b))

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10 << ((unit & 512) >> 6))

    def _child(self, base: int, byte: int) -> int:
        """The node behind a byte, 0 if there is none."""
        node = base ^ byte
        inside = node < len(self.units) and self.units[node] & 0x800000FF == byte
        return node if inside else 0

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest entry that ``data`` has at ``at``."""
        base, found = self._base(0), None
        for i in range(at, len(data)):
            node = self._child(base, data[i])
            if not node:
                break
            base = self._base(node)
            if self.units[node] >> 8 & 1:
                found = self.units[base] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start, length = found
        return self.strings[start : self.strings.index(b"\0", start)], length


class Encoding(NamedTuple):
    """Ids of a text and the byte range of the text behind each."""

    ids: list[int]
    starts: np.ndarray
    ends: np.ndarray


class PieceEncoder:
    """The model of one file."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        with open(model, "rb") as source:
            data = source.read()
        self.processor = SentencePieceProcessor(model_proto=data)
        parts = list(_fields(data))
        rules = dict(_fields(b"".join(v for f, v in parts if f == _NORMALIZER)))
        trainer = dict(_fields(b"".join(v for f, v in parts if f == _TRAINER)))
        self.map = CharMap(rules.get(_CHARSMAP, b""))
        self.dummy, self.extra, self.escape = (bool(rules.get(f, 1)) for f in (_DUMMY, _EXTRA, _ESCAPE))
        self.as_suffix = bool(trainer.get(_AS_SUFFIX, 0))
        pieces = [dict(_fields(v)) for f, v in parts if f == _PIECES]
        kinds = [p.get(_PIECE_TYPE, 1) for p in pieces]
        self.names = [str(i) for i in range(len(pieces))]
        # bytes of normalised text that a piece covers
        self.sizes = np.array([1 if k == _BYTE else len(p[_PIECE_TEXT]) for p, k in zip(pieces, kinds)], np.int64)
        self.unknown = kinds.index(_UNKNOWN)
        self.end = self.processor.eos_id()
        own = sorted((p[_PIECE_TEXT] for p, k in zip(pieces, kinds) if k == _USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, own))) if own else None
        starts = set(self.map.starts) | {w[0] for w in own}
        self.special = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in sorted(starts)) + b"]") if starts else None
        plain = b"".join(_field(f, 0) for f in (_DUMMY, _EXTRA, _ESCAPE))
        rest = b"".join(_field(f, v) for f, v in parts if f != _NORMALIZER)
        self.segmenter = SentencePieceProcessor(model_proto=rest + _field(_NORMALIZER, _field(1, b"identity") + plain))

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Text after the character map, and where each of its bytes came from."""
        if not self.special:
            return data, np.arange(len(data) + 1)
        out, origin, done = [], [], 0
        for hit in self.special.finditer(data):
            at = hit.start()
            if at < done:
                continue
            kept = self.own.match(data, at) if self.own else None
            change = (kept[0], len(kept[0])) if kept else self.map.longest(data, at) if self.map.units else None
            if not change:
                continue
            new, length = change
            out += [data[done:at], new]
            origin += [np.arange(done, at), np.full(len(new), at)]
            done = at + length
        out.append(data[done:])
        origin.append(np.arange(done, len(data) + 1))
        return b"".join(out), np.concatenate(origin)

    def normalized(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the byte of ``data`` it came from."""
        text, origin = self._mapped(data)
        if self.extra:
            blank = np.frombuffer(text, np.uint8) == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]])) if len(blank) else blank
            origin = origin[np.append(keep, True)]
            text = np.frombuffer(text, np.uint8)[keep].tobytes()
        if not text:
            return text, origin[-1:]
        if self.dummy and not self.as_suffix:
            text, origin = b" " + text, np.concatenate([origin[:1], origin])
        sign = b" "
        if self.escape:
            sign = _BLANK
            wide = np.where(np.frombuffer(text, np.uint8) == 32, len(sign), 1)
            origin = np.repeat(origin, np.append(wide, 1))
            text = text.replace(b" ", sign)
        if self.extra:
            # a blank's sign that stood in the text counts as a blank at its end
            last = len(text)
            while text.endswith(sign, 0, last):
                last -= len(sign)
            text, origin = text[:last], origin[: last + 1]
        if self.dummy and self.as_suffix:
            text, origin = text + sign, np.concatenate([origin, np.repeat(origin[-1:], len(sign))])
        return text, origin

    def encode(self, data: list[bytes], end: bool = True) -> Iterator[Encoding]:
        """Ids and byte ranges of each text.

        The end id covers nothing behind the last byte. A byte piece covers the
        byte it came from; a blank put before a text covers nothing.
        """
        normal = [self.normalized(d) for d in data]
        found = self.segmenter.encode([text.decode() for text, _ in normal], out_type=int, num_threads=1)
        for (text, origin), ids in zip(normal, found):
            sizes = self.sizes[ids]
            if sizes.sum() != len(text):
                # pieces without a size of their own: unknown ones in a model without byte pieces
                surfaces = self.segmenter.encode(text.decode(), out_type=str)
                ids = [self.segmenter.piece_to_id(s) for s in surfaces]
                sizes = np.array([len(s.encode()) if i == self.unknown else self.sizes[i] for s, i in zip(surfaces, ids)])
            border = origin[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            starts, ends = border[:-1], border[1:]
            if end:
                ids = [*ids, self.end]
                starts, ends = np.append(starts, border[-1]), np.append(ends, border[-1])
            yield Encoding(ids, starts, ends)

    def in_slices(self, data: list[bytes], end: bool = True) -> Iterator[Encoding]:
        """As ``encode``, some ``SLICE`` bytes at a time."""
        start = size = 0
        for at, text in enumerate(data):
            size += len(text)
            if size >= SLICE or at == len(data) - 1:
                yield from self.encode(data[start : at + 1], end)
                start, size = at + 1, 0


@functools.lru_cache(maxsize=2)
def piece_encoder(model: str) -> PieceEncoder:
    return PieceEncoder(model)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


_PIECE = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def encoded(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """``doc_id`` and ``pieces`` (id, start, end) of every document.

    ``start`` and ``end`` are bytes of the UTF-8 text, end exclusive. ``model`` is
    the path of a model file that every executor can open; ``end`` appends the
    model's end id. ``docs`` needs ``doc_id`` and ``text``, other columns are left
    out. A null text is empty: it has the end id only. Rows that repeat an id are
    encoded each; an empty table gives no rows; a text of any length is encoded
    whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = piece_encoder(model)
        for batch in batches:
            docs_, at = batch.column(0), 0
            data = [t or b"" for t in texts(batch.column(1))]
            for one in tool.in_slices(data, end):
                pieces = pa.StructArray.from_arrays(
                    [pa.array(one.ids, pa.int32()), pa.array(one.starts, pa.int64()), pa.array(one.ends, pa.int64())],
                    fields=list(_PIECE.value_type),
                )
                row = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
                yield pa.RecordBatch.from_arrays([docs_.slice(at, 1), row.cast(_PIECE)], ["doc_id", "pieces"])
                at += 1

    return _input(docs).mapInArrow(run, "doc_id bigint, pieces array<struct<id:int,start:bigint,end:bigint>>")


def decoded(pieces: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of encoded documents, as the model decodes their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = piece_encoder(model)
        for batch in batches:
            back = [tool.processor.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], ["doc_id", "text"])

    ids = F.transform("pieces", lambda p: p["id"]).alias("ids")
    return pieces.select("doc_id", ids).mapInArrow(run, "doc_id bigint, text string")


_DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint"
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """Number of ids, digests of the ids and of the decoded text, and a checksum of the byte ranges.

    ``spans_crc32`` is taken over the pairs of start and end as little-endian
    64-bit numbers. Nulls, repeated ids and empty tables are as in ``encoded``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = piece_encoder(model)
        for batch in batches:
            rows = []
            for one in tool.in_slices([t or b"" for t in texts(batch.column(1))]):
                listed = " ".join(map(tool.names.__getitem__, one.ids)).encode()
                back = tool.processor.decode(one.ids).encode()
                spans = np.stack([one.starts, one.ends], 1).astype("<i8").tobytes()
                rows.append(
                    (len(one.ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(back).hexdigest(), zlib.crc32(spans))
                )
            columns = list(zip(*rows)) if rows else [[] for _ in _DIGEST_TYPES[1:]]
            arrays = [pa.array(c, t) for c, t in zip(columns, _DIGEST_TYPES[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [p.split()[0] for p in _DIGEST.split(", ")])

    return _input(docs).mapInArrow(run, _DIGEST)
