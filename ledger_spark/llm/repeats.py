"""Removal of byte strings that occurred before, decided by suffix order.

Every ``LENGTH``-byte string has an anchor: the position of the smallest 8-byte
hash among its first ``REACH`` positions. Equal strings have equal anchors at the
same distance, so strings are compared only within one anchor:

1. Anchors that occur once in the whole corpus are dropped, by one sort of
   anchor hashes.
2. Each other anchor brings its context, which is the bytes of all strings that
   it anchors. Of equal contexts the first stands for all.
3. Contexts are cut to the parts that other contexts of the anchor may share, by
   hashes. Of equal parts, again, the first stands for all. The different parts
   are concatenated, their suffixes sorted by linear grouping, and neighbours in
   suffix order that agree in their first ``LENGTH`` bytes form the groups of
   equal strings. All but the first of a group are removed.
4. An anchor with more different contexts than one task should hold gives the
   128-bit hash of each of its strings instead; these are spread over all tasks,
   and all but the first of equal hashes are removed.

Work is split by anchor, however long the texts are, and the suffix order is only
built where copies differ: at the edges of repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.hashing import mix, texts
from ledger_spark.llm.ngram_join import BROADCAST_IDS
from ledger_spark.llm.suffix_groups import suffix_array
from ledger_spark.staging import stage

LENGTH = 100
REACH = 68
ANCHOR = LENGTH - REACH
# Bytes of a text that are searched at once, of contexts that are compared at once,
# and of contexts that are sorted at once.
SLAB = 1 << 22
# Bytes of short texts that are searched together; below SLAB.
TOGETHER = 1 << 18
DECIDED_BYTES = 1 << 20
SORTED_BYTES = 1 << 17
# Bytes of different contexts from which an anchor is decided by string hashes.
HOT_BYTES = 1 << 21
# Contexts remembered by one task before its memory is emptied.
MEMO_CONTEXTS = 500_000

_PLACE_BITS = np.uint64(23)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    return np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8")[:, 0]


def _windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(text: bytes, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of a text its hash, and the first and last start of the strings it anchors.

    Long texts are searched in slabs; an anchor at a slab's edge may be given
    twice, for the strings before and after the edge. ``ends`` are those of several
    texts that were joined; strings do not cross them.
    """
    hashes, firsts, lasts = [], [], []
    for base in range(0, max(len(text) - LENGTH + 1, 0), SLAB):
        data = np.frombuffer(text[base : base + SLAB + LENGTH - 1], np.uint8)
        grams = _grams(data)
        ranked = (mix(grams) & ~((np.uint64(1) << _PLACE_BITS) - np.uint64(1))) | np.arange(len(grams), dtype=np.uint64)
        starts = len(data) - LENGTH + 1
        at = (_windows_min(ranked, REACH)[:starts] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        start = np.arange(starts)
        if ends is not None:
            whole = np.ones(starts, bool)
            for end in (ends - base).tolist():
                whole[max(end - LENGTH + 1, 0) : max(end, 0)] = False
            start = start[whole]
            at = at[whole]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
        place = at[first]
        whole = np.zeros(len(place), np.uint64)
        for k in range(0, ANCHOR, 8):
            whole = mix(whole + grams[place + k])
        hashes.append(whole)
        firsts.append(start[first] + base)
        lasts.append(start[np.r_[first[1:], len(at)][: len(first)] - 1] + base)
    if not hashes:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _together(many: Iterator[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of ``TOGETHER`` bytes at most, or one longer text, with the place of the first."""
    begin, size, group = 0, 0, []
    for at, text in enumerate(many):
        if group and size + len(text) > TOGETHER:
            yield begin, group
            begin, size, group = at, 0, []
        group.append(text)
        size += len(text)
    if group:
        yield begin, group


def _anchors_together(group: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, where each begins, their anchors, and the text that each anchor is in."""
    whole = b"".join(group)
    ends = np.cumsum([len(text) for text in group])
    found, first, last = anchors(whole, ends if len(group) > 1 else None)
    return whole, np.r_[0, ends[:-1]], found, first, last, np.searchsorted(ends, first, "right")


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        for at, group in _together(texts(batch.column(1))):
            _, begins, found, first, _, owner = _anchors_together(group)
            yield pa.RecordBatch.from_pydict(
                {"anchor": pa.array(found.view(np.int64)), "row": pa.array(rows[at + owner]), "at": pa.array(first - begins[owner])}
            )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose anchor occurs more than once; the input is sorted by anchor."""
    last, waiting = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy(zero_copy_only=False)
        same = anchor[1:] == anchor[:-1]
        keep = np.r_[anchor[0] == last, same] | np.r_[same, False]
        if anchor[0] == last and waiting is not None:
            yield waiting
        last = anchor[-1]
        end = batch.select([1, 2]).slice(batch.num_rows - 1)
        waiting = None if keep[-1] else end
        yield batch.select([1, 2]).filter(pa.array(keep))


_CONTEXT = "anchor bigint, row bigint, first bigint, last bigint, bytes binary"
_SCHEMA = pa.schema(
    [("anchor", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("bytes", pa.binary())]
)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of repeated anchors; a null context marks strings that are known to repeat.

    Rows come in ascending order within a task, so a context that the task has
    seen before repeats an earlier one. Neighbours of that kind are one row.
    """
    seen: set[bytes] = set()
    for batch in batches:
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        starts = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        counts = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        bounds = np.r_[0, np.cumsum(counts)]
        for at, group in _together(texts(batch.column(2))):
            if len(seen) > MEMO_CONTEXTS:
                seen.clear()
            whole, begins, found, first, last, owner = _anchors_together(group)
            wanted = np.zeros(len(whole), bool)
            wanted[starts[bounds[at] : bounds[at + len(group)]] + np.repeat(begins, counts[at : at + len(group)])] = True
            chosen = wanted[first]
            found, first, last, owner = found[chosen], first[chosen], last[chosen], owner[chosen]
            data = [whole[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
            # add() gives None
            known = np.array([key in seen or bool(seen.add(key)) for key in map(xxhash.xxh3_128_digest, data)], bool)
            going = known[1:] & known[:-1] & (owner[1:] == owner[:-1]) & (first[1:] <= last[:-1] + LENGTH)
            head = np.flatnonzero(np.r_[True, ~going][: len(known)])
            tail = np.r_[head[1:], len(known)][: len(head)] - 1
            begin, own = begins[owner[head]], rows[at + owner[head]]
            kept = [None if k else data[i] for i, k in zip(head.tolist(), known[head].tolist())]
            columns = found[head].view(np.int64), own, first[head] - begin, last[tail] - begin, kept
            yield pa.RecordBatch.from_pydict(dict(zip(_SCHEMA.names, columns)), _SCHEMA)


def repeated_stretches(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, start and end of the ``LENGTH``-byte strings that an earlier context or start has.

    Contexts are joined with a symbol below all bytes between them. Strings that
    begin one after another are one stretch.
    """
    data = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    borders = np.cumsum([len(c) for c in contexts], dtype=np.int64) + np.arange(len(contexts))
    symbols = data.astype(np.int64) + 1
    symbols[borders] = 0
    begins = np.r_[0, borders[:-1] + 1] if contexts else borders
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    order = order[borders[np.searchsorted(borders, order)] - order >= LENGTH]
    later = np.zeros(len(data) + 1, bool)
    if len(order):
        grams, same = _grams(data), np.ones(len(order) - 1, bool)
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            now = grams[order + k]
            same &= now[1:] == now[:-1]
        later[order] = True
        later[np.minimum.reduceat(order, np.flatnonzero(np.r_[True, ~same]))] = False
    edges = np.flatnonzero(np.diff(later, prepend=False))
    first, last = edges[::2], edges[1::2] - 1
    number = np.searchsorted(borders, first)
    return number, first - begins[number], last - begins[number] + LENGTH


Entry = tuple[int, int, int, bytes]


def _shared_parts(entries: list[Entry]) -> Iterator[Entry]:
    """The parts of contexts whose strings may also be in another context of the anchor.

    ``entries`` are (anchor number, row, start, bytes). Strings are compared by
    hashes here, over all contexts at once.
    """
    data = np.frombuffer(b"".join(e[3] for e in entries), np.uint8)
    sizes = np.array([len(e[3]) for e in entries])
    ends = np.cumsum(sizes)
    count = len(data) - LENGTH + 1
    total, step = _grams(data), 8
    while step * 2 <= LENGTH:
        total = mix(total[:-step] * _TIMES + total[step:])
        step *= 2
    rest = LENGTH - step
    total = mix(total[:count] * _TIMES + total[rest : rest + count])
    owner = np.repeat(np.arange(len(entries)), sizes)[:count]
    at = np.flatnonzero(np.arange(count) + LENGTH <= ends[owner])
    number = np.array([e[0] for e in entries], np.uint64)[owner[at]]
    total = total[at] + mix(number)
    order = np.argsort(total)
    total = total[order]
    same = total[1:] == total[:-1]
    shared = np.zeros(len(at), bool)
    shared[order] = np.r_[same, False] | np.r_[False, same]
    at = at[shared]
    if not len(at):
        return
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(owner[at]) != 0)])
    for first, last in zip(at[new].tolist(), at[np.r_[new[1:], len(at)] - 1].tolist()):
        anchor, row, start, whole = entries[owner[first]]
        a = first - int(ends[owner[first]] - sizes[owner[first]])
        yield anchor, row, start + a, whole[a : a + last - first + LENGTH]


def _settle(entries: list[Entry]) -> pa.RecordBatch:
    """Stretches of the shared parts of whole anchors, earlier rows first.

    Of equal parts the first stands for all; the different parts of an anchor
    are put in suffix order.
    """
    rows, starts, ends = [], [], []
    groups: dict[int, dict[bytes, tuple[int, int]]] = {}
    for anchor, row, start, part in _shared_parts(entries) if entries else ():
        group = groups.setdefault(anchor, {})
        if part in group:
            rows.append(row)
            starts.append(start)
            ends.append(start + len(part))
        else:
            group[part] = row, start

    def order(parts: list[tuple[bytes, tuple[int, int]]]) -> None:
        for number, a, b in zip(*(c.tolist() for c in repeated_stretches([part for part, _ in parts]))):
            row, start = parts[number][1]
            rows.append(row)
            starts.append(start + a)
            ends.append(start + b)

    pending: list[tuple[bytes, tuple[int, int]]] = []
    for group in groups.values():
        if len(group) > 1:
            pending += group.items()
            if sum(len(part) for part, _ in pending) > SORTED_BYTES:
                order(pending)
                pending = []
    order(pending)
    return _stretches(rows, starts, ends)


_DECIDED = "row bigint, start bigint, end bigint, high bigint, low bigint"


def _string_rows(group: list[Entry]) -> pa.RecordBatch:
    """Every string of some contexts with its hash, to be decided elsewhere."""
    data = np.frombuffer(b"".join(e[3] for e in group), np.uint8)
    sizes = np.array([len(e[3]) for e in group])
    ends = np.cumsum(sizes)
    count = len(data) - LENGTH + 1
    owner = np.repeat(np.arange(len(group)), sizes)[:count]
    at = np.flatnonzero(np.arange(count) + LENGTH <= ends[owner])
    owner = owner[at]
    grams = _grams(data)
    high, low = np.zeros(len(at), np.uint64), np.full(len(at), LENGTH, np.uint64)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        high, low = mix(high + grams[at + k]), mix((low ^ grams[at + k]) + np.uint64(2 * k + 1))
    start = at - (ends - sizes)[owner] + np.array([e[2] for e in group])[owner]
    return _decided(np.array([e[1] for e in group])[owner], start, start + LENGTH, high.view(np.int64), low.view(np.int64))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed stretches (row, start, end); input sorted by anchor, row and first start.

    Strings of an anchor beyond ``HOT_BYTES`` come with their hashes, undecided.
    Equal contexts have equal anchors, so those of a batch are found at once.
    """
    entries: list[Entry] = []
    group: list[Entry] = []
    size = held = number = 0
    hot = False
    anchor, seen = None, set()
    for batch in batches:
        rows, starts, ends = [], [], []
        codes = batch.column(4).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        fresh = codes > np.maximum.accumulate(np.r_[-1, codes[:-1]])[: len(codes)]
        again = batch.select([1, 2, 3]).filter(pa.array(~fresh))
        yield _stretches(again.column(0), again.column(1), pc.add(again.column(2), LENGTH))
        # an anchor with one context has nothing to compare, unless it may go on in another batch
        batch = batch.filter(pa.array(fresh))
        new = np.diff(batch.column(0).to_numpy(zero_copy_only=False)) != 0
        more = np.ones(batch.num_rows, bool)
        more[1:-1] = ~(new[:-1] & new[1:])
        columns = [column.to_pylist() for column in batch.filter(pa.array(more)).columns]
        for now, row, first, last, data in zip(*columns):
            if now != anchor:
                if hot and group:
                    yield _string_rows(group)
                elif len(group) > 1:
                    entries += group
                    size += held
                if size > DECIDED_BYTES:
                    yield _settle(entries)
                    entries, size = [], 0
                anchor, group, seen, held, hot = now, [], set(), 0, False
                number += 1
            if data in seen:
                rows.append(row)
                starts.append(first)
                ends.append(last + LENGTH)
            else:
                seen.add(data)
                group.append((number, row, first, data))
                held += len(data)
                if held > (DECIDED_BYTES if hot else HOT_BYTES):
                    # of what is let go here, equal strings meet by their hashes
                    for at in range(0, len(group), 2048):
                        yield _string_rows(group[at : at + 2048])
                    hot, group, seen, held = True, [], set(), 0
        yield _stretches(rows, starts, ends)
    if hot and group:
        yield _string_rows(group)
        group = []
    yield _settle(entries + (group if len(group) > 1 else []))


def _later_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings that follow an equal one; input sorted by hash, row and start."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        same = np.r_[(high[0], low[0]) == last, (high[1:] == high[:-1]) & (low[1:] == low[:-1])]
        last = high[-1], low[-1]
        yield batch.select([0, 1, 2]).filter(pa.array(same))


def _stretches(rows, starts, ends) -> pa.RecordBatch:
    nothing = pa.nulls(len(rows), pa.int64())
    return _decided(rows, starts, ends, nothing, nothing)


def _decided(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], ["row", "start", "end", "high", "low"])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a set of stretches."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[new], reach[np.r_[new[1:], len(reach)] - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        spans = batch.column(2).flatten()
        bounds = np.r_[0, np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))].tolist()
        edges = [spans.field(i).to_numpy(zero_copy_only=False) for i in range(2)]
        for text, low, high in zip(texts(batch.column(1)), bounds, bounds[1:]):
            starts, ends = merged(*(e[low:high] for e in edges))
            at, kept = 0, []
            for a, b in zip(starts.tolist(), ends.tolist()):
                kept.append(text[at:a])
                at = b
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int((ends - starts).sum()))
            out["n_spans"].append(len(starts))
            out["kept"].append(b"".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(out["doc_id"], batch.schema.field(0).type),
                "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "n_spans": pa.array(out["n_spans"], pa.int64()),
                "kept": pa.array(out["kept"], pa.binary()),
            }
        )


def _numbered(docs: DataFrame) -> DataFrame:
    """``row`` (ascending by doc_id), ``doc_id`` and ``text`` without nulls.

    The doc_id is the row number unless it is missing or repeats; then a copy of
    the table is numbered in the order of doc_id (none first) and text.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return docs.select(F.col("doc_id").alias("row"), "doc_id", "text")
    ordered = docs.orderBy("doc_id", "text")
    return stage(ordered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")


def removed_stretches(rows: DataFrame) -> DataFrame:
    """Stretches (``row``, ``start``, ``end`` in bytes) that only hold strings with an earlier copy."""
    found = rows.select("row", "text").mapInArrow(_anchor_rows, "anchor bigint, row bigint, at bigint")
    found = found.repartition("anchor").sortWithinPartitions("anchor")
    again = found.mapInArrow(_repeated, "row bigint, at bigint").groupBy("row").agg(F.collect_list("at").alias("starts"))
    again = stage(again, "anchors")
    both = again.join(rows.select("row", "text"), "row").sortWithinPartitions("row")
    contexts = both.select("row", "starts", "text").mapInArrow(_contexts, _CONTEXT)
    contexts = contexts.repartition("anchor").sortWithinPartitions("anchor", "row", "first")
    decided = stage(contexts.mapInArrow(_decide, _DECIDED), "decided")
    strings = decided.filter("high IS NOT NULL").repartition("high", "low").sortWithinPartitions("high", "low", "row", "start")
    later = strings.mapInArrow(_later_strings, "row bigint, start bigint, end bigint")
    return decided.filter("high IS NULL").select("row", "start", "end").union(later)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Remove every byte that is covered by a ``LENGTH``-byte string with an earlier copy.

    Earlier means a smaller doc_id, or the same document and an earlier start;
    strings never cross documents and are judged on the input. ``docs`` needs
    ``doc_id`` and ``text``; other columns are ignored. One row per input row:
    ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept`` (the remaining bytes). A null text is empty. Rows without doc_id
    come first, and rows that repeat a doc_id follow each other by their text;
    each is a document of its own.
    """
    rows = _numbered(docs)
    spans = removed_stretches(rows).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = stage(spans, "spans")
    ids = spans.select("row")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    whole = rows.join(ids, "row", "left_anti")
    size = F.octet_length("text").cast("bigint")
    zero = F.lit(0).cast("bigint")
    clean = whole.select(
        "doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )
    touched = rows.join(ids, "row", "left_semi").join(spans, "row").select("doc_id", "text", "spans")
    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return clean.union(touched.mapInArrow(_cut, kind))


def repeat_report(docs: DataFrame) -> DataFrame:
    """``without_repeats`` with the digest of the remaining bytes in their place."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans"]
    return without_repeats(docs).select(*names, F.sha2("kept", 256).alias("kept_sha256"))
