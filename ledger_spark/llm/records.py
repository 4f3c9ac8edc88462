"""Token ids in length-delimited binary records, with an offset index.

A record file is a run of frames: the payload's length (8 bytes), a masked
checksum of those bytes (4), the payload, a masked checksum of the payload (4),
all little-endian. A payload is a flag byte (1 if there is an id), the doc_id (8
bytes) and the token ids in the width that the vocabulary needs. The index file
beside it holds each frame's offset and length as pairs of 8-byte numbers, so
records can be read in any order without scanning.

Documents are range-partitioned and sorted by doc_id, rows of one id by the hash of
their text; each task writes one record file and one index file under names of its
own. Only files whose task succeeded are in the manifest, so a repeated or
speculative task leaves no trace in it; ``remove_strays`` deletes what it left.
"""

from __future__ import annotations

import functools
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.staging import new_path, stage

END_ID = 0
# Pieces of text whose ids a worker remembers, in each of two generations.
MEMO_PIECES = 400_000
# Different runs of marks whose ids a worker remembers.
MEMO_MARKS = 10_000
# Characters of the longest piece that is remembered.
MEMO_LENGTH = 200
# Bytes of text cut into pieces at once, new pieces that are encoded as one text, and
# characters that the tokenizer gets in a call, whose objects take a hundred times as much.
SLICE = 4_000_000
JOINED = 500
CALL = 500_000
# Bytes of frames read at once, bytes that one read task takes, and the most read tasks.
READ_BYTES = 8 << 20
RANGE_BYTES = 64 << 20
READ_TASKS = 20_000

_HEAD, _TAIL, _NAME = "<QI", "<I", "<Bq"
_NAME_BYTES = struct.calcsize(_NAME)
# Fixed value: the constant of the usual checksum mask.
_MASK = 0xA282EAD8
# A space and a line end at the start of a token, in byte-level vocabularies.
_SHOWN = {" ": "Ġ", "\n": "Ċ"}


def _table(characters: str) -> np.ndarray:
    """Of each byte, whether it is one of these ASCII characters."""
    found = np.zeros(256, bool)
    found[list(characters.encode())] = True
    return found


_MARKS = _table(string.punctuation)
_WORD = _table(string.ascii_letters + string.digits)
# Blanks beyond ASCII, their two or three bytes read as a number.
_BLANKS = [c.encode() for c in map(chr, range(128, 0x10000)) if c.isspace()]
_BLANKS_2, _BLANKS_3 = ([int.from_bytes(b) for b in _BLANKS if len(b) == n] for n in (2, 3))


def masked(data: bytes) -> int:
    """Rotated and shifted CRC-32, so that checksums of checksums stay useful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return struct.pack(_HEAD, len(payload), masked(length)) + payload + struct.pack(_TAIL, masked(payload))


def unframe(data: memoryview) -> memoryview:
    """The payload of one whole frame; ValueError if a checksum or length is wrong."""
    length, check = struct.unpack_from(_HEAD, data)
    if check != masked(bytes(data[:8])) or len(data) != length + 16:
        raise ValueError("damaged record length")
    payload = data[12 : 12 + length]
    if struct.unpack_from(_TAIL, data, 12 + length)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def _three(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three bytes from each of these places on, as a number."""
    one, two, three = (data.take(at + k, mode="clip").astype(np.int64) for k in range(3))
    return one << 16 | two << 8 | three


def _beside_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a blank beyond ASCII ends before or begins behind each of these bytes."""
    left, right = _three(data, at - 3), _three(data, at + 1)
    two = np.isin(left & 0xFFFF, _BLANKS_2) | np.isin(right >> 8, _BLANKS_2)
    return two | np.isin(left, _BLANKS_3) | np.isin(right, _BLANKS_3)


def _behind_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a digit or a letter of ASCII or U+00C0 to U+023F ends before each of these bytes."""
    lead, last = data.take(at - 2, mode="clip"), data[at - 1]
    # later letters may be unknown to the tokenizer's tables; two of these characters are signs
    latin = (lead >= 0xC3) & (lead <= 0xC8) & (last >= 0x80) & (last <= 0xBF)
    return _WORD[last] | latin & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))


class Memo:
    """Ids of strings, in two generations: a full young one replaces the old one."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}

    def missing(self, wanted: list[str]) -> list[str]:
        """Those of ``wanted`` that are neither young nor old; old ones become young."""
        absent = [w for w in wanted if w not in self.young]
        self.young |= {w: self.old[w] for w in absent if w in self.old}
        return [w for w in absent if w not in self.old]


class Encoder:
    """Token ids of texts, as bytes.

    The tokenizer splits before a space that stands between two other characters,
    so the texts are cut there, as bytes and all at once, and each different piece
    is encoded once and remembered. Byte-level tokenizers also split before such a
    line end and between a letter or digit and a mark, so there the marks at the
    end of a word are pieces of their own. New pieces are joined and encoded as one
    text. Its ids are cut before every token that begins with the piece's space or
    line end, if that gives as many parts as there are pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces = Memo(MEMO_PIECES)
        before = self.tokenizer.pre_tokenizer
        plain = self.tokenizer.normalizer is None and isinstance(before, ByteLevel)
        self.cuts_marks = plain and before.use_regex and not before.add_prefix_space
        self.opening = {opener: self._beginning(shown) for opener, shown in _SHOWN.items() if opener == " " or self.cuts_marks}
        self.openers = _table("".join(self.opening))
        self.marks: dict[str, bytes] = {}
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]

    def _beginning(self, shown: str) -> np.ndarray:
        """Of each id, whether its token begins with ``shown``."""
        vocabulary = self.tokenizer.get_vocab()
        found = np.zeros(max(vocabulary.values()) + 1, bool)
        found[[i for token, i in vocabulary.items() if token.startswith(shown)]] = True
        return found

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        start, size = 0, 0
        for at, text in enumerate(texts, 1):
            size += len(text)
            if size >= CALL or at == len(texts):
                for encoded in self.tokenizer.encode_batch_fast(texts[start:at], add_special_tokens=False):
                    yield np.array(encoded.ids, self.width)
                start, size = at, 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self._encoded(texts)]

    def _of_marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= MEMO_MARKS:
                self.marks.clear()
            self.marks[marks] = self._ids([marks])[0]
        return self.marks[marks]

    def _of_pieces(self, pieces: list[str], opener: str = " ") -> Iterator[tuple[str, bytes]]:
        """Each piece with the ids of the opener and the piece."""
        # the end of a text, a blank piece and one with spaces inside are no words between openers
        alone = [p for p in pieces if not p or " " in p or opener in p or p[-1].isspace()]
        words = list(set(pieces).difference(alone)) if alone else pieces
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._encoded([opener + opener.join(g) for g in groups])):
            starts = (np.flatnonzero(self.opening[opener][ids]) * self.width.itemsize).tolist()
            if len(starts) == len(group) and not starts[0]:
                data = ids.tobytes()
                yield from zip(group, map(data.__getitem__, map(slice, starts, [*starts[1:], len(data)])))
            else:
                alone += group
        yield from zip(alone, self._ids([opener + p for p in alone]))

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of these pieces."""
        known, rest = self.pieces.young, pieces
        for opener in self.opening:
            opened = [p[1:] for p in rest if p.startswith(opener)]
            rest = [p for p in rest if not p.startswith(opener)]
            known.update((opener + p, ids) for p, ids in self._of_pieces(opened, opener))
        marks = {p for p in rest if len(p) <= MEMO_LENGTH and not p.strip(string.punctuation)}
        known.update((p, self._of_marks(p)) for p in marks)
        rest = [p for p in rest if p not in marks]
        known.update(zip(rest, self._ids(rest)))

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each place of ``data``, whether a text may be cut there; ``bounds`` are the ends of the texts."""
        found = np.zeros(len(data) + 1, bool)
        at = np.flatnonzero(self.openers[data[1:-1]]) + 1
        at = at[(data[at - 1] > 32) & (data[at + 1] > 32)]
        wide = np.flatnonzero((data[at - 1] > 127) | (data[at + 1] > 127))
        found[np.delete(at, wide[_beside_blank(data, at[wide])])] = True
        if self.cuts_marks:
            mark = _MARKS[data]
            edges = np.flatnonzero(mark[1:] != mark[:-1]) + 1
            first = mark[edges]
            starts, ends = edges[first], np.append(edges[~first], len(data))
            ends = ends[int(mark[0]) :][: len(starts)]
            last = (data[np.minimum(ends, len(data) - 1)] <= 32) | (bounds[np.searchsorted(bounds, ends)] == ends)
            starts = starts[last]
            found[starts[_behind_letter(data, starts)]] = True
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found[at : at + len(token) + 1] = False
                at = raw.find(token, at + 1)
        return found

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of the texts between the ``bounds`` of ``data``, UTF-8 bytes from the first bound to the last."""
        if not len(data):
            return [b""] * (len(bounds) - 1)
        cuts = self._cuts(data, bounds)
        cuts[bounds] = True
        places = np.flatnonzero(cuts)
        buffers = [None, pa.py_buffer(places), pa.py_buffer(data)]
        pieces = pa.Array.from_buffers(pa.large_string(), len(places) - 1, buffers).dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.pieces.turn()
        missing = self.pieces.missing(different)
        self._learn(missing)
        ids = pa.array(map(self.pieces.young.__getitem__, different), pa.large_binary(), size=len(different))
        for piece in missing:
            if len(piece) > MEMO_LENGTH:
                del self.pieces.young[piece]
        _, ends, ids = ids.take(pieces.indices).buffers()
        ends = np.frombuffer(ends, np.int64)[np.searchsorted(places, bounds)].tolist()
        return list(map(memoryview(ids).tobytes()[: ends[-1]].__getitem__, map(slice, ends, ends[1:])))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for _, ids in self.in_slices(pa.array(texts, pa.large_string()))]

    def in_slices(self, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        """Number and ids of each text, encoding about ``SLICE`` bytes at a time."""
        texts = texts.cast(pa.large_string())
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
            first, last = bounds[at], bounds[upto]
            yield from enumerate(self._encode(data[first:last], bounds[at : upto + 1] - first), at)
            at = upto


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _write(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        end = np.array([END_ID], tool.width).tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        offsets, lengths, tokens, at = [], [], 0, 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{name}.rec")
            docs = batch.column(0).to_pylist()
            for number, data in tool.in_slices(batch.column(1)):
                doc = docs[number]
                data = frame(struct.pack(_NAME, doc is not None, doc or 0) + data + end)
                out.write(data)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
                tokens += (len(data) - 16 - _NAME_BYTES) // tool.width.itemsize
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{name}.idx") as index:
            index.write(np.array([offsets, lengths], "<u8").T.tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int64()),
                "file": [name.removeprefix(root + "/")],
                "n_records": pa.array([len(offsets)], pa.int64()),
                "n_tokens": pa.array([tokens], pa.int64()),
                "n_bytes": pa.array([at], pa.int64()),
                "width": pa.array([tool.width.itemsize], pa.int64()),
            }
        )

    return run


def write_records(docs: DataFrame, vocabulary: str, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode ``docs`` into record files; gives their folder and the manifest.

    ``docs`` needs ``doc_id`` and ``text``; ``vocabulary`` is the path of a
    tokenizer file that every executor can open. Rows are in ascending doc_id
    order (without id first), file after file; many rows of one id are spread
    over files by the hash of their text, and are in the order of the texts
    within a file. Rows that repeat wholly are written each. A null text is empty; long texts are written whole;
    every document ends with id 0. An empty table gives an empty manifest. Other
    columns, whatever their names, are ignored. Folder: below the shared folder
    unless given; local paths and what Arrow's file systems open. The manifest
    has a row per file: ``part`` (its order), ``file`` (name without suffix),
    ``n_records``, ``n_tokens``, ``n_bytes``, ``width`` (bytes of an id) and
    ``start`` (tokens in the files before).
    """
    folder = folder or new_path(docs.sparkSession, "records")
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # equal rows are interchangeable: a number spreads them over files
    chosen = chosen.withColumn("turn", F.rand(1))
    ordered = chosen.repartitionByRange("doc_id", F.xxhash64("text"), "turn").drop("turn")
    ordered = ordered.sortWithinPartitions("doc_id", "text")
    manifest = stage(
        ordered.mapInArrow(
            _write(folder, vocabulary),
            "part bigint, file string, n_records bigint, n_tokens bigint, n_bytes bigint, width bigint",
        ),
        "manifest",
    )
    # one row per file
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    return folder, manifest.withColumn("start", before)


def remove_strays(folder: str, manifest: DataFrame) -> int:
    """Delete files of failed attempts, which the manifest does not name; gives their number.

    Call it when no job writes to ``folder``. The driver holds a name per file.
    """
    named = {r["file"] for r in manifest.select("file").collect()}
    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    strays = [f.path for f in found if f.base_name.endswith((".rec", ".idx")) and f.base_name[:-4] not in named]
    for path in strays:
        store.delete_file(path)
    return len(strays)


class RecordFile:
    """One record file, read through its index: any record, in any order."""

    def __init__(self, folder: str, file: str, width: int):
        store, root = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/{file}.idx") as index:
            self.index = np.frombuffer(index.read(), "<u8").reshape(-1, 2).astype(np.int64)
        self.source = store.open_input_file(f"{root}/{file}.rec")
        self.width = np.dtype(f"<u{width}")

    def __len__(self) -> int:
        return len(self.index)

    def _decode(self, data: memoryview) -> tuple[int | None, np.ndarray]:
        payload = unframe(data)
        has, doc = struct.unpack_from(_NAME, payload)
        return (doc if has else None), np.frombuffer(payload[_NAME_BYTES :], self.width)

    def record(self, number: int) -> tuple[int | None, np.ndarray]:
        offset, length = self.index[number].tolist()
        return self._decode(memoryview(self.source.read_at(length, offset)))

    def span(self, number: int, size: int) -> tuple[int, int]:
        """First record and end of the ``number``-th range of ``size`` bytes; a record is where it starts."""
        first, upto = np.searchsorted(self.index[:, 0], [number * size, (number + 1) * size])
        return int(first), int(upto)

    def tokens_before(self, number: int) -> int:
        return int((self.index[:number, 1] - 16 - _NAME_BYTES).sum()) // self.width.itemsize

    def records(self, at: int = 0, end: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """Records ``at`` to ``end`` in order, read in large blocks."""
        end = len(self.index) if end is None else end
        while at < end:
            first = int(self.index[at, 0])
            upto = min(end, max(at + 1, int(np.searchsorted(self.index[:, 0], first + READ_BYTES))))
            size = int(self.index[upto - 1].sum()) - first
            block = memoryview(self.source.read_at(size, first))
            for offset, length in self.index[at:upto].tolist():
                yield self._decode(block[offset - first : offset - first + length])
            at = upto


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, width, number, size in zip(*(batch.column(i).to_pylist() for i in range(5))):
                docs, starts, counts, sums = [], [], [], []
                source = RecordFile(folder, file, width)
                at, end = source.span(number, size)
                start += source.tokens_before(at)
                for doc, ids in source.records(at, end):
                    docs.append(doc)
                    starts.append(start)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(docs, pa.int64()),
                        "start": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )

    return run


def read_digests(folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every record, checksums verified.

    ``ids_crc32`` is taken over the ids as little-endian 32-bit numbers. Files are
    read in ranges of ``RANGE_BYTES``, a task each.
    """
    last = F.floor((F.col("n_bytes") - 1) / F.lit(RANGE_BYTES)).cast("bigint")
    ranges = manifest.withColumn("number", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    tasks = max(1, min(ranges.count(), READ_TASKS))
    turn = F.row_number().over(Window.orderBy("part", "number"))
    ranges = ranges.withColumn("turn", F.pmod(turn, F.lit(tasks)).cast("int"))
    ranges = ranges.repartitionById(tasks, F.col("turn"))
    ranges = ranges.select("file", "start", "width", "number", F.lit(RANGE_BYTES).cast("bigint").alias("size"))
    return ranges.mapInArrow(_read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def record_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the records of ``docs`` and describe each document as read back.

    Odd rows as in ``write_records``; an empty table gives no rows.
    """
    return read_digests(*write_records(docs, vocabulary))
