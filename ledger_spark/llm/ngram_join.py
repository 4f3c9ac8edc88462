"""Documents linked by the Jaccard similarity of their word n-grams.

The document by n-gram incidence is a sparse 0/1 matrix; the product with its
transpose holds the overlap of every pair. Only the blocks that can matter are
multiplied:

1. Columns are ordered from rare to frequent by a fixed-size count sketch over
   all documents. Any common order is exact; this one keeps frequent columns
   out of the blocks.
2. Documents with equal sets are one row. A row takes part with its first
   ``size - required + 1`` columns: two linked rows share one of these.
3. Small columns multiply all their row pairs; a grouped sum adds up the
   overlaps of a pair over the blocks. Pairs whose sum, together with the most
   that the remaining columns can add, stays below the size-derived bound are
   discarded.
4. A large column first compares its rows with one pivot row only. Rows that are
   thereby connected need no further comparison. Columns whose rows are still in
   different components are multiplied on sketches: the parity of a row's columns
   in each of about as many bits as it has columns bounds the overlap of two rows
   from above. Rows that sketches connect form a group, where each comes once, with
   its whole set; the others, that only share a passage, are done. A group is
   multiplied in blocks of bounded size, inside tasks: bitmaps first, then the sets
   are compared. A block keeps a forest of what it has linked and gives out the
   links of the forest only, fewer than its rows.
5. Remaining pairs that their sketches allow get their exact overlap from the whole
   rows.

Links within one component that are not needed to connect it are never
given out, so a group of thousands of near copies costs about its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.graph import components
from ledger_spark.llm.hashing import mix, shingle_sets, sort_parts, texts
from ledger_spark.staging import stage

# Counters of the column sketch (a power of two) and rows in which it travels.
SKETCH = 1 << 20
SKETCH_ROWS = 16
# Rows of a column up to which all its pairs are multiplied.
SMALL_COLUMN = 16
# A column whose counter is above this, and above EVEN times the mean counter, is
# taken as large without looking; no other column can have more rows than that.
LARGE_COUNT = 1024
EVEN = 8
# Candidate ids up to this number are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000

# Parts over which the entries of a large column are dealt.
LARGE_PARTS = 64

# Rows whose columns a task handles, and gives out, at once.
OUT_ROWS = 500

# Bits of a row's bitmap, and rows of one block of a group.
BITMAP = 2048
BLOCK = 2048
# Pairs of rows whose sketches are compared at once.
PAIRS = 1 << 16

# A key holds the level in its upper 7 bits: four levels for each doubling of the count.
_LEVELS = 4
_SHIFT = 57
_LOW = np.uint64((1 << _SHIFT) - 1)


def _plain(column: pa.Array) -> list[bytes]:
    return [text or b"" for text in texts(column)]


def _count_columns(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                for found, _ in shingle_sets(_plain(whole.column(0).slice(at, OUT_ROWS)), n):
                    slots = (found & np.uint64(SKETCH - 1)).astype(np.int64)
                    counts += np.bincount(slots, minlength=SKETCH).astype(np.uint32)
        parts = counts.reshape(SKETCH_ROWS, -1)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(range(SKETCH_ROWS), pa.int32()),
                "counts": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
            }
        )

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            new = np.frombuffer(zlib.decompress(counts.as_py()), np.uint32).astype(np.uint64)
            sums[part] = sums[part] + new if part in sums else new
    if sums:
        levels = [(_LEVELS * np.log2(s + 1)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(list(sums), pa.int32()), "levels": pa.array(levels, pa.binary())}
        )


def column_levels(docs: DataFrame, n: int) -> bytes:
    """Rounded logarithm of each sketch counter: ``SKETCH`` bytes whatever the input."""
    counted = docs.select("text").mapInArrow(_count_columns(n), "part int, counts binary")
    merged = counted.repartition(SKETCH_ROWS, "part").mapInArrow(_add_counts, "part int, levels binary")
    rows = {r["part"]: bytes(r["levels"]) for r in merged.collect()}
    empty = bytes(SKETCH // SKETCH_ROWS)
    return b"".join(rows.get(i, empty) for i in range(SKETCH_ROWS))


def _columns(many: list[bytes], n: int, levels: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's columns in the common order, as 64-bit keys: level, then hash."""
    for found, bounds in shingle_sets(many, n):
        level = levels[(found & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
        keys = (level << np.uint64(_SHIFT)) | ((found >> np.uint64(64 - _SHIFT)) & _LOW)
        sort_parts(keys, bounds)
        yield from (keys[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))


def bitmap(keys: np.ndarray) -> bytes:
    """``BITMAP`` bits, one set for each column of a row."""
    bits = np.zeros(BITMAP, bool)
    bits[(keys & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def sketch(keys: np.ndarray) -> bytes:
    """Parity of the number of a row's columns in each bit; the next power of two of bits, 64 at least.

    Each column that only one of two rows has turns one bit, so rows differ in as many
    columns as in bits, or more. Halves of a sketch joined by "exclusive or" are the
    sketch of half as many bits.
    """
    bits = max(64, 1 << (len(keys) - 1).bit_length())
    slots = (keys & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(bool)).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of ``words`` 64-bit words from sketches of the same or a larger number."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def _apart(size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Most columns in which linked rows of these sizes differ."""
    return size_a + size_b + 2 * (-percent * (size_a + size_b) // (100 + percent))


def required(size: int, percent: int) -> int:
    """Least overlap of a row of ``size`` columns with any linked row."""
    return (size * percent + 99) // 100


def _rows(n: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(levels.value, np.uint8)
        for batch in (whole.slice(at, OUT_ROWS) for whole in batches for at in range(0, whole.num_rows, OUT_ROWS)):
            sizes, sets, firsts, sketches = [], [], [], []
            for keys in _columns(_plain(batch.column(1)), n, order):
                sizes.append(len(keys))
                sets.append(xxhash.xxh3_128_digest(keys.tobytes()) if len(keys) else None)
                sketches.append(sketch(keys) if len(keys) else None)
                firsts.append(keys[: len(keys) - required(len(keys), percent) + 1].tobytes() if len(keys) else None)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "size": pa.array(sizes, pa.int64()),
                    "set": pa.array(sets, pa.binary()),
                    "first": pa.array(firsts, pa.binary()),
                    "sketch": pa.array(sketches, pa.binary()),
                }
            )

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, OUT_ROWS):
            batch = whole.slice(at, OUT_ROWS)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            parts = [np.frombuffer(v.as_py(), np.int64) for v in batch.column(2)]
            lengths = [len(p) for p in parts]
            yield pa.RecordBatch.from_pydict(
                {
                    "col": pa.array(np.concatenate(parts)),
                    "id": pa.array(np.repeat(ids, lengths)),
                    "size": pa.array(np.repeat(sizes, lengths).astype(np.int32)),
                }
            )


def _products(percent: int, small: int, large: int):
    """Row pairs of small columns; entries of larger columns pass on.

    The input is sorted by column and size, and only a column of level ``large`` or
    more spans partitions. The entries of the last column of a batch wait for the
    next batch.
    """

    def split(cols, ids, sizes):
        starts = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]])
        runs = np.diff(np.r_[starts, len(cols)])
        run = np.repeat(runs, runs)
        # a part of a large column passes on however small it is
        run[(cols.view(np.uint64) >> np.uint64(_SHIFT)) >= np.uint64(large)] = small + 1
        left, right = [], []
        for d in range(1, small):
            i = np.flatnonzero((cols[d:] == cols[:-d]) & (run[d:] <= small))
            i = i[sizes[i] * 100 >= sizes[i + d] * percent]
            left.append(i)
            right.append(i + d)
        a, b = np.concatenate(left), np.concatenate(right)
        big = np.flatnonzero(run > small)
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        none = np.full(len(big), None)
        return pa.RecordBatch.from_pydict(
            {
                "col": pa.array(np.r_[np.full(len(a), None), cols[big]], pa.int64()),
                "a": pa.array(np.r_[ids[a], ids[big]]),
                "size_a": pa.array(np.r_[sizes[a], sizes[big]].astype(np.int64)),
                "b": pa.array(np.r_[ids[b], none], pa.int64()),
                "size_b": pa.array(np.r_[sizes[b], none], pa.int64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            now = [np.concatenate(x) for x in zip(held, now)]
            cut = np.searchsorted(now[0], now[0][-1])
            held = [x[cut:] for x in now]
            if cut:
                yield split(*(x[:cut] for x in now))
        if len(held[0]):
            yield split(*held)

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def only_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is in ``ids`` (distinct, staged), or is not.

    The ids are broadcast only if their counted number is within a fixed limit.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _prefix(size: str, percent: int):
    return F.expr(f"{size} - cast(floor(({size} * {percent} + 99) / 100) as bigint) + 1")


def _may_link(overlap, percent: int):
    """Whether ``overlap`` shared first columns still allow the similarity.

    Behind the first columns of a pair only the rest of one of its rows can be
    shared: the rest of the row whose first columns end earlier in the order.
    """
    rest_a = F.col("size_a") - _prefix("size_a", percent)
    rest_b = F.col("size_b") - _prefix("size_b", percent)
    need = F.expr(f"ceil({percent} * (size_a + size_b) / {100 + percent})")
    return overlap + F.greatest(rest_a, rest_b) >= need


def _alike(percent: int):
    return F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Link documents whose word n-gram sets have Jaccard ``percent``/100 or more.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are ignored.
    One row per input row: ``doc_id``, ``n_shingles`` (size of its set) and
    ``component_id``, the smallest doc_id reachable by links, itself included.

    A null or blank text has an empty set and no links. Rows without doc_id come
    back with their set size and a null component. Rows that repeat a doc_id are
    separate rows of one document: they share the smallest of their components.
    An empty table gives an empty result; a text of any length takes part whole.
    Sets are compared by 64-bit hashes of their n-grams (58 bits for overlaps).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    levels = column_levels(docs, n)
    mean = np.exp2(np.frombuffer(levels, np.uint8) / _LEVELS).mean()
    large = int(np.ceil(_LEVELS * np.log2(max(LARGE_COUNT, EVEN * mean))))
    shared = spark.sparkContext.broadcast(levels)

    schema = "doc_id bigint, size bigint, set binary, first binary, sketch binary"
    rows = stage(docs.mapInArrow(_rows(n, percent, shared), schema), "rows")
    sets = rows.filter("set IS NOT NULL AND doc_id IS NOT NULL").groupBy("set")
    reps = sets.agg(F.min(F.struct("doc_id", "size", "first")).alias("r"))
    reps = reps.select(F.col("r.doc_id").alias("id"), "r.size", "r.first")
    entries = reps.mapInArrow(_entries, "col bigint, id bigint, size int")

    # entries are made and shuffled once, those of a large column in several parts
    part = F.pmod(F.xxhash64("id"), F.lit(LARGE_PARTS))
    part = F.when(F.shiftrightunsigned("col", _SHIFT) >= large, part).otherwise(F.lit(0))
    entries = entries.repartition("col", part).sortWithinPartitions("col", "size", "id")
    products = stage(
        entries.mapInArrow(
            _products(percent, SMALL_COLUMN, large), "col bigint, a bigint, size_a bigint, b bigint, size_b bigint"
        ),
        "products",
    )
    wide = products.filter("b IS NULL").select("col", F.col("a").alias("id"), F.col("size_a").alias("size"))
    wide = stage(wide, "wide")
    sketches = stage(_sketches(rows), "sketches")

    in_large = wide.groupBy("id").agg(F.count("*").alias("n"))
    pairs = products.filter("b IS NOT NULL").groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("c"))
    pairs = (
        pairs.join(in_large.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a", "left")
        .join(in_large.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b", "left")
        .filter(_may_link(F.col("c") + F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))), percent))
        .select("a", "b")
    )
    pairs = stage(pairs.union(_with_pivot(wide, percent, 0)).distinct(), "pairs")
    links = stage(_verified(docs, _possible(pairs, sketches, percent), n, percent, shared), "links")
    found = components(links)

    wide = _undecided(wide, found)
    if wide is not None:
        more = stage(_with_pivot(wide, percent, 1).distinct(), "pairs")
        links = stage(links.union(_verified(docs, _possible(more, sketches, percent), n, percent, shared)), "links")
        found = components(links)
        wide = _undecided(wide, found)
    turn = 0
    while wide is not None:
        more = stage(_within_groups(docs, wide, n, percent, shared, turn, sketches), "pairs")
        right = stage(_verified(docs, more, n, percent, shared).distinct(), "right")
        links = stage(links.union(right), "links")
        found = components(links)
        if right.count() == more.count():
            break
        # shortened hashes took a pair for linked that is not: again with other bits
        wide, turn = _undecided(wide, found), turn + 1

    named = sets.agg(F.min("doc_id").alias("id")).join(found, "id", "left").select("set", F.coalesce("component", "id").alias("component_id"))
    # rows without a set are linked with nothing and would all meet in one task
    linked = rows.filter("set IS NOT NULL").select("doc_id", F.col("size").alias("n_shingles"), "set").join(named, "set", "left")
    alone = rows.filter("set IS NULL").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    joined = linked.drop("set").unionByName(alone)
    whole = joined.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
    return _one_document(whole)


def _with_pivot(wide: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each row of a large column with the column's pivot, sizes allowing.

    The first turn takes the smallest hashed id of the column, the next one
    the smallest of another hash.
    """
    pivot = wide.groupBy("col").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "size")).alias("p"))
    pivot = pivot.select("col", F.col("p.id").alias("b"), F.col("p.size").alias("size_b"))
    both = wide.select("col", F.col("id").alias("a"), F.col("size").alias("size_a")).join(pivot, "col")
    both = both.filter((F.col("a") != F.col("b")) & _alike(percent))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _undecided(wide: DataFrame, found: DataFrame) -> DataFrame | None:
    """Entries of the columns whose rows are not all in one component yet."""
    wide = wide.select("col", "id", "size").join(found, "id", "left")
    wide = wide.select("col", "id", "size", F.coalesce("component", "id").alias("component"))
    ends = wide.groupBy("col").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    wide = stage(wide.join(ends.filter("lo < hi").select("col"), "col"), "wide")
    return None if wide.isEmpty() else wide


def _sketches(rows: DataFrame) -> DataFrame:
    """The size and sketch of each id's set; null for an id with several sets."""
    given = rows.filter("set IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    given = given.agg(*(F.min(c).alias(c) for c in ("set", "size", "sketch")), F.max("set").alias("other"))
    one = F.col("set") == F.col("other")
    return given.select("id", *(F.when(one, F.col(c)).alias(c) for c in ("size", "sketch")))


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow the similarity."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for size_a, size_b, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if x is not None and y is not None:
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    words = min(len(x), len(y))
                    differ = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64)
                    keep.append(bool(differ <= _apart(size_a, size_b, percent)))
                else:
                    keep.append(True)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    for end in ("a", "b"):
        named = sketches.select(
            F.col("id").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}")
        )
        pairs = pairs.join(named, end, "left")
    pairs = pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
    return stage(pairs.mapInArrow(allowed, "a bigint, b bigint"), "possible")


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """Rows of each group in blocks of about ``BLOCK``; a row goes to every pair of blocks with its own."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    rows = rows.join(counts, group).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _by_block(rows: DataFrame, group: str, values: list[str], multiply: Callable) -> DataFrame:
    """Links from ``multiply``, called with the rows of one pair of blocks, smallest first."""
    rows = rows.select(group, "lo", "hi", "own", "size", "id", "component", *values)
    rows = rows.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "size", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, binary = [np.zeros(0, np.int64)] * 7, [[] for _ in values]
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)]
            held = [np.concatenate(x) for x in zip(held, now)]
            binary = [b + batch.column(7 + i).to_pylist() for i, b in enumerate(binary)]
            new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            starts = np.r_[0, new].tolist()
            for x, y in zip(starts, new.tolist()):
                yield from multiply([h[x:y] for h in held], *(b[x:y] for b in binary))
            held, binary = [h[starts[-1] :] for h in held], [b[starts[-1] :] for b in binary]
        if len(held[0]):
            yield from multiply(held, *binary)

    return rows.mapInArrow(run, "a bigint, b bigint")


def _links(left: list[int], right: list[int], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    if left:
        a, b = ids[left], ids[right]
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _within_groups(
    docs: DataFrame, wide: DataFrame, n: int, percent: int, levels, turn: int, sketches: DataFrame
) -> DataFrame:
    """Links that join rows of different components in undecided columns, most likely right.

    Rows of an undecided column whose sketches allow a link are connected, and rows that
    are thereby connected form a group. A group's rows are dealt over blocks of about
    ``BLOCK`` rows, and a row goes to every pair of blocks that has its own; one pair of
    blocks is multiplied at a time. Sets travel as 32 bits of each column's hash, other
    ones in each ``turn``: that may take two rows for more alike than they are, never
    for less.
    """
    dealt = _dealt(wide.select("col", "id", "size", "component"), "col").join(sketches.select("id", "sketch"), "id", "left")
    links = stage(_by_block(dealt, "col", ["sketch"], _sketch_links(percent)).distinct(), "likely")
    group = components(links).withColumnRenamed("component", "group")
    members = stage(wide.select("id", "component").distinct().join(group, "id"), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(levels.value, np.uint8)
        for batch in (whole.slice(at, OUT_ROWS) for whole in batches for at in range(0, whole.num_rows, OUT_ROWS)):
            keys = list(_columns(_plain(batch.column(1)), n, order))
            short = [np.unique(mix(k + np.uint64(turn)).astype(np.uint32)).tobytes() for k in keys]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "size": pa.array([len(k) for k in keys], pa.int64()),
                    "bits": pa.array([bitmap(k) for k in keys], pa.binary()),
                    "cols": pa.array(short, pa.binary()),
                }
            )

    # a repeated id brings each of its texts
    held = only_ids(docs, stage(members.select(F.col("id").alias("doc_id")), "ids"))
    whole = held.mapInArrow(sets, "id bigint, size bigint, bits binary, cols binary").filter("size > 0").distinct()
    rows = _dealt(members, "group").join(whole, "id")
    return _by_block(rows, "group", ["bits", "cols"], _block_links(percent)).distinct()


def _sketch_links(percent: int):
    """A forest over the rows of each pair of blocks whose sketches allow a link between two components."""

    def multiply(held: list[np.ndarray], sketches: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        _, lo, hi, own, size, ids, component = held
        # two rows can be linked while others have joined their components: rows are labelled, not components
        label = np.arange(len(ids))
        # sizes ascend, so the rows that are not too large follow directly
        ends = np.maximum(np.searchsorted(size, size * 100 // percent, "right"), np.arange(len(ids)) + 1)
        words = np.array([len(x or b"") // 8 for x in sketches])
        place = np.zeros(len(ids), np.int64)
        tables = {}
        for w in set(words.tolist()):
            of = np.flatnonzero(words == w)
            place[of] = np.arange(len(of))
            tables[w] = np.frombuffer(b"".join(sketches[i] or b"" for i in of.tolist()), np.uint64).reshape(len(of), w)
        counts = ends - np.arange(len(ids)) - 1
        steps = np.searchsorted(np.cumsum(counts), np.arange(0, counts.sum(), PAIRS), "right")
        left, right = [], []
        for x, y in zip(steps, np.r_[steps[1:], len(ids)]):
            i = np.repeat(np.arange(x, y), counts[x:y])
            j = np.arange(len(i)) - np.repeat(np.cumsum(counts[x:y]) - counts[x:y], counts[x:y]) + i + 1
            other = (component[i] != component[j]) & (label[i] != label[j])
            if lo[0] != hi[0]:
                other &= own[i] != own[j]
            i, j = i[other], j[other]
            differ = np.zeros(len(i), np.int64)
            for v, w in {(v, w) for v in tables for w in tables if v and w}:
                at = np.flatnonzero((words[i] == v) & (words[j] == w))
                if len(at):
                    p, q = folded(tables[v][place[i[at]]], min(v, w)), folded(tables[w][place[j[at]]], min(v, w))
                    differ[at] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
            likely = differ <= _apart(size[i], size[j], percent)
            for p, q in zip(i[likely].tolist(), j[likely].tolist()):
                if label[p] != label[q]:
                    label[label == label[q]] = label[p]
                    left.append(p)
                    right.append(q)
        yield from _links(left, right, ids)

    return multiply


def _block_links(percent: int):
    """The links of a forest over the rows of each pair of blocks."""

    def multiply(held: list[np.ndarray], maps: list[bytes], cols: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, lo, hi, own, size, ids, component = held
        # rows that are known to be linked have one label
        label = np.unique(component, return_inverse=True)[1]
        bits = np.frombuffer(b"".join(maps), np.uint64).reshape(-1, BITMAP // 64)
        sets = [np.frombuffer(c, np.uint32) for c in cols]
        left, right = [], []
        for i in range(len(ids) - 1):
            # sizes ascend, so the rows that are not too large follow directly
            end = np.searchsorted(size, size[i] * 100 // percent, "right")
            j = np.arange(i + 1, max(end, i + 1))
            j = j[label[j] != label[i]]
            if lo[i] != hi[i]:
                j = j[own[j] != own[i]]
            if not len(j):
                continue
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            need = -(-percent * (size[j] + size[i]) // (100 + percent))
            likely = apart <= size[j] + size[i] - 2 * need
            for k, least in zip(j[likely].tolist(), need[likely].tolist()):
                if label[k] == label[i]:
                    continue
                # shared columns whose shortened hashes are equal count once
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True)) + size[i] - len(sets[i])
                if both >= least:
                    label[label == label[k]] = label[i]
                    left.append(i)
                    right.append(k)
        yield from _links(left, right, ids)

    return multiply


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int, levels) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    ids = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(levels.value, np.uint8)
        for batch in (whole.slice(at, OUT_ROWS) for whole in batches for at in range(0, whole.num_rows, OUT_ROWS)):
            found = [keys.tobytes() for keys in _columns(_plain(batch.column(1)), n, order)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "cols": pa.array(found, pa.binary())})

    whole = stage(only_ids(docs, ids).mapInArrow(sets, "doc_id bigint, cols binary"), "sets")
    both = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("cols").alias("cols_a")), "a")
    both = both.join(whole.select(F.col("doc_id").alias("b"), F.col("cols").alias("cols_b")), "b")
    return both.select("a", "b", "cols_a", "cols_b").mapInArrow(_exact(percent), "a bigint, b bigint")


def _one_document(rows: DataFrame) -> DataFrame:
    """Give all rows of a repeated doc_id the smallest component among them."""
    rows = stage(rows, "components")
    twice = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    twice = stage(twice.select("doc_id"), "twice")
    if twice.isEmpty():
        return rows
    bridges = rows.join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    merged = components(bridges).withColumnRenamed("id", "component_id")
    return rows.join(merged, "component_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of ``docs``, with all their columns, of the smallest doc_id of each component.

    Rows without doc_id stay; of rows that repeat a doc_id, one stays.
    """
    found = stage(ngram_components(docs, n, percent).filter("doc_id IS NOT NULL"), "found")
    copies = stage(found.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = only_ids(docs, copies, "left_anti").select(*docs.columns)
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    twice = stage(twice, "twice")
    if twice.isEmpty():
        return kept
    once = only_ids(kept, twice).dropDuplicates(["doc_id"])
    return only_ids(kept, twice, "left_anti").select(*docs.columns).union(once.select(*docs.columns))
