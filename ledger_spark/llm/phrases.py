"""Frequent word sequences and collocations by partitioning.

The table is dealt into a few shards of whole tasks. A sequence that occurs at
least ``least`` times must occur, in some shard, at least ``least`` times that
shard's share of the text; so each shard is mined completely at that lower local
support, and the union of what the shards keep holds every frequent sequence.
Mining goes by length as usual: sequences of one and two words first, then those
of three words whose two pairs were kept. A last pass over the text counts all
candidates exactly, and the global support is applied to these counts.

Local mining works on hashes of sequences. Equal sequences have equal hashes, so
a collision can only add a candidate; the last pass counts the words themselves.
Candidates travel to the tasks as a bitmap of bounded size, which may also let a
sequence pass in vain but never holds one back.

Tasks count blocks of a million words at a time. Mining cuts words from the bytes
of many texts at once and needs their hashes only. Counting numbers the words of a
block, a sequence becomes three numbers of 21 bits in one integer, and only
different sequences leave the block, a few at a time. No word is a Python object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.llm.hashing import mix, texts, word_hashes
from ledger_spark.staging import stage

# Shards mined at lower support. Below ``least``, so that one occurrence is not enough.
SHARDS = 4
# Words counted at once; below 2^20, so that their numbers fit 21 bits.
BLOCK = 1_000_000
# Bytes of text that are cut into words at once, and rows given to Spark at once.
SLAB = 1 << 21
ROWS = 1 << 16
# Bits of the candidate bitmap: for each candidate, and at most (32 MB).
BITS_EACH = 16
MOST_BITS = 1 << 28

NO_LANGUAGE = "und"

_LONGEST = 3
_JOIN = np.uint64(0x9E3779B97F4A7C15)
_WIDTH = 21
# bits in one row of Spark's bitmap functions
_ROW_BITS = 32768

# Piece borders, and the blanks between words.
_BORDERS = b".,;:!?\n\v\f\r"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BORDERS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_BORDERS) + b" "
)
_SPACE, _LINE = (pa.scalar(c, pa.large_binary()) for c in (b" ", b"\n"))
_BLANK = re.compile(b"[\n ]")
_FOLLOWING = re.compile(rb"(?:[\n ]*[^\n ]+){1,%d}" % (_LONGEST - 1))


class Block:
    """The next words of some texts, with the sequences that begin at each.

    ``data`` holds the words' bytes without the blanks between them, ``sizes`` their
    lengths, ``language`` their places in ``names``, ``one`` hashes of word and
    language. ``begins`` tells where a sequence of one, two and three words begins.
    """

    def __init__(self, names: list[str], language: np.ndarray, one: np.ndarray, begins: list[np.ndarray], data: np.ndarray, sizes: np.ndarray):
        self.names, self.language, self.one, self.begins, self.data, self.sizes = names, language, one, begins, data, sizes

    def numbered(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The number of each word, and by number the word and its place in ``names``."""
        offsets = pa.array(np.r_[0, np.cumsum(self.sizes)], pa.int64())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.sizes), [None, offsets.buffers()[1], pa.py_buffer(self.data)])
        words = words.dictionary_encode()
        pairs = words.indices.to_numpy().astype(np.int64) * len(self.names) + self.language
        pairs = pa.array(pairs).dictionary_encode()
        word, language = np.divmod(pairs.dictionary.to_numpy(), len(self.names))
        return pairs.indices.to_numpy().astype(np.int64), words.dictionary.take(pa.array(word)), language


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a sequence and of the word behind it."""
    return mix(first[: len(second)] * _JOIN + second)


def _packed(numbers: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The words of the sequences that begin at ``at``, in one integer each."""
    return sum(numbers[at + i] << _WIDTH * (_LONGEST - 1 - i) for i in range(length))


def unpacked(packed: np.ndarray, place: int) -> np.ndarray:
    return packed >> _WIDTH * (_LONGEST - 1 - place) & (1 << _WIDTH) - 1


Part = tuple[str, bytes, int]


def _parts(language: str, text: bytes) -> Iterator[Part]:
    """Parts of a text with the sequences that begin within their first bytes.

    A long text is cut between words; a part also holds the words that sequences
    need which begin before its end.
    """
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        blank = _BLANK.search(text, at + SLAB)
        end = blank.start() if blank else len(text)
        following = _FOLLOWING.match(text, end)
        yield language, text[at : following.end() if following else end], end - at
        at = end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    parts, size = [], 0
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            for part in _parts(language, text or b""):
                parts.append(part)
                size += len(part[1])
                if size >= SLAB:
                    yield from _cut(parts)
                    parts, size = [], 0
    yield from _cut(parts)


def _cut(parts: list[Part]) -> Iterator[Block]:
    """Blocks of the words of some parts of texts."""
    whole = b"\n".join(text for _, text, _ in parts)
    data = np.frombuffer(whole, np.uint8)
    inside = (data != 32) & (data != 10)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return
    # parts of texts are parted by a line end, so a piece lies in one part
    piece = np.cumsum(~inside & (data == 10), dtype=np.int32)[starts]
    first = np.cumsum([0, *(len(text) + 1 for _, text, _ in parts[:-1])])
    part = np.searchsorted(first, starts, "right") - 1
    counted = starts < (first + [end for _, _, end in parts])[part]
    places: dict[str, int] = {}
    language = np.array([places.setdefault(name, len(places)) for name, _, _ in parts])[part]
    seeds = np.array([xxhash.xxh3_64_intdigest(name.encode()) for name in places], np.uint64)
    one = mix(word_hashes([whole])[0] + seeds[language])
    for at in range(0, len(starts), BLOCK):
        own = slice(at, at + BLOCK + _LONGEST - 1)
        own_piece, going = piece[own], counted[own].copy()
        going[BLOCK:] = False
        begins = [going]
        for i in range(1, _LONGEST):
            begins.append(going & np.r_[own_piece[i:] == own_piece[: len(own_piece) - i], np.zeros(min(i, len(own_piece)), bool)])
        low, high = starts[at], starts[own][-1] + sizes[own][-1]
        yield Block(list(places), language[own], one[own], begins, data[low:high][inside[low:high]], sizes[own])


class Bitmap:
    """Bounded set of hashes that may hold more than was put in, never less."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.mask = np.uint64(8 * len(data) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap_of(hashes: DataFrame) -> bytes:
    """Bitmap of a table of hashes: its size follows their number, up to ``MOST_BITS``."""
    count = hashes.count()
    bits = _ROW_BITS
    while bits < min(count * BITS_EACH, MOST_BITS):
        bits *= 2
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    row = F.floor(at / _ROW_BITS).cast("bigint").alias("row")
    rows = hashes.select(row, at.alias("at")).groupBy("row")
    # at most bits / 32768 rows of 4 KB
    found = rows.agg(F.bitmap_construct_agg(F.col("at") % _ROW_BITS).alias("bitmap")).toLocalIterator()
    data = bytearray(bits // 8)
    for number, bitmap in found:
        data[number * _ROW_BITS // 8 : number * _ROW_BITS // 8 + len(bitmap)] = bitmap
    return bytes(data)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text")
    )


def _supports(rows: DataFrame, least: int, shards: int) -> Column:
    """Local support of each shard: its share of the text times the global one, rounded up.

    Any shares that sum to one keep every frequent sequence, so a task that reads
    other rows than it did here costs pruning and no result.
    """
    shard = F.pmod(F.spark_partition_id(), F.lit(shards)).alias("shard")
    sizes = rows.select(shard, F.octet_length("text").alias("bytes")).groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    # at most ``shards`` rows
    size = {r["shard"]: r["bytes"] or 0 for r in sizes.collect()}
    total = max(1, sum(size.values()))
    local = {s: max(1, -(-least * b // total)) for s, b in size.items()}
    pairs = [F.lit(x) for pair in local.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("shard")), F.lit(1)) if pairs else F.lit(1)


def _mined(shards: int, pairs=None):
    """Local counts of sequences: one and two words, or three words whose two pairs are candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bitmap(pairs.value) if pairs else None
        shard = TaskContext.get().partitionId() % shards
        for block in _blocks(batches):
            one = block.one
            two = joined(one, one[1:])
            at = np.flatnonzero(block.begins[2 if known else 1])
            if known:
                at = at[known.has(two[at])]
                at = at[known.has(two[at + 1])]
                hashes, counts = np.unique(mix(two[at] * _JOIN + one[at + 2]), return_counts=True)
            else:
                hashes, counts = np.unique(np.r_[one[block.begins[0]], two[at]], return_counts=True)
            for i in range(0, len(hashes), ROWS):
                own = slice(i, i + ROWS)
                columns = np.full(len(hashes[own]), shard, np.int32), hashes[own].view(np.int64), counts[own]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "hash", "n"])

    return run


def _entries(phrases: pa.Array, languages: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    entry = pc.binary_join_element_wise(phrases, languages, _LINE).cast(pa.large_string())
    return pa.RecordBatch.from_arrays([entry.cast(pa.string()), pa.array(counts)], ["entry", "n"])


def _counted(candidates):
    """Exact counts of candidates and, as sequences of no words, of all words of a language.

    A sequence and its language are one value, parted by a line end, which no word holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = (Bitmap(c.value) for c in candidates)
        for block in _blocks(batches):
            one = block.one
            two = joined(one, one[1:])
            three = joined(two, one[2:])
            numbers, words, language = block.numbered()
            names = pa.array([name.encode() for name in block.names], pa.large_binary())
            for length, known, hashes in ((1, short, one), (2, short, two), (3, long, three)):
                at = np.flatnonzero(block.begins[length - 1])
                at = at[known.has(hashes[at])]
                packed, n = np.unique(_packed(numbers, at, length), return_counts=True)
                for i in range(0, len(packed), ROWS):
                    own = [unpacked(packed[i : i + ROWS], k) for k in range(length)]
                    phrase = pc.binary_join_element_wise(*(words.take(pa.array(k)) for k in own), _SPACE)
                    yield _entries(phrase, names.take(pa.array(language[own[0]])), n[i : i + ROWS])
            totals = np.bincount(block.language[block.begins[0]], minlength=len(names))
            yield _entries(pa.array([b""] * len(names), pa.large_binary()), names, totals)

    return run


def frequent_phrases(docs: DataFrame, least: int, shards: int = SHARDS) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``n`` of all sequences of one to three words that occur ``least`` times or more.

    A row with ``words`` 0 and an empty phrase gives the number of words of each
    language. Sequences do not cross the border of a piece (``.,;:!?`` and line
    ends); overlapping occurrences count. A-Z is lower-cased.
    """
    if least < 1 or shards < 1:
        raise ValueError("least and shards are 1 or more")
    spark, rows = docs.sparkSession, _input(docs)
    enough = _supports(rows, least, shards)
    candidates = []
    for _ in range(2):
        local = rows.mapInArrow(_mined(shards, *candidates), "shard int, hash bigint, n bigint")
        counted = local.groupBy("shard", "hash").agg(F.sum("n").alias("n"))
        kept = stage(counted.filter(F.col("n") >= enough).select("hash"), "candidates")
        candidates.append(spark.sparkContext.broadcast(bitmap_of(kept)))
    found = rows.mapInArrow(_counted(candidates), "entry string, n bigint")
    total = found.groupBy("entry").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("entry", "\n", 1)
    words = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ", -1)))
    total = total.filter((F.col("n") >= least) | F.startswith("entry", F.lit("\n"))).select(
        F.expr("substr(entry, instr(entry, '\n') + 1)").alias("lang"), phrase.alias("phrase"), words.alias("words"), "n"
    )
    result = stage(total, "phrases")
    for candidate in candidates:
        candidate.unpersist()
    return result


def _part(start: int, length: int) -> Column:
    words = F.split("phrase", " ", -1)
    return F.array_join(F.slice(words, start + 1, length), " ")


def _with_count(rows: DataFrame, counts: DataFrame, words: int, part: Column, name: str) -> DataFrame:
    """Add how often a part of the phrase occurs."""
    chosen = counts.filter(F.col("words") == words).select("lang", F.col("phrase").alias("__part"), F.col("n").alias(name))
    return rows.withColumn("__part", part).join(chosen, ["lang", "__part"]).drop("__part")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    above = (F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a)).cast("decimal(37,0)")
    below = (wide(left) * wide(right)).cast("decimal(30,0)")
    return F.call_function("div", above, below)


def collocations(
    docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000, shards: int = SHARDS
) -> DataFrame:
    """The ``top`` phrases of two and three words of each language, by how much their parts attract each other.

    ``docs`` needs ``lang`` and ``text``, other columns are left out. A phrase
    occurs ``a`` >= ``least`` times. Cut in two, its parts occur ``l`` and ``r``
    times, and its score is floor(1000000 a a / (l r)) at the cut where that is
    lowest (the earliest of equal ones). A phrase is left out if a longer one that
    holds it occurs ``percent`` % as often or more. Equal scores are ordered by
    ``a`` descending, then by phrase in byte order. ``n`` is the number of words
    of the language.

    A null language is ``und``, a null or empty text has no words, repeated rows
    count each, an empty table gives no rows, a text of any length is read whole.
    """
    counts = frequent_phrases(docs, least, shards)
    two, three = (counts.filter(F.col("words") == k).select("lang", "phrase", F.col("n").alias("a")) for k in (2, 3))

    # pairs inside a longer candidate that occurs nearly as often
    inside = three.select("lang", "a", F.explode(F.array(_part(0, 2), _part(1, 2))).alias("phrase"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    two = two.join(longest, ["lang", "phrase"], "left")
    two = two.filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")

    two = _with_count(_with_count(two, counts, 1, _part(0, 1), "l"), counts, 1, _part(1, 1), "r")
    two = two.withColumn("score", _score("a", "l", "r"))
    for left, right in ((1, 2), (2, 1)):
        three = _with_count(three, counts, left, _part(0, left), f"l{left}")
        three = _with_count(three, counts, right, _part(left, right), f"r{left}")
        three = three.withColumn(f"s{left}", _score("a", f"l{left}", f"r{left}"))
    earlier = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang",
        "phrase",
        "a",
        *[F.when(earlier, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(o) for c, o in (("l", "l"), ("r", "r"), ("s", "score"))],
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    both = two.select(three.columns).unionByName(three)
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # one row per language
    words = counts.filter(F.col("words") == 0).select("lang", "n")
    ranked = ranked.join(words, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
