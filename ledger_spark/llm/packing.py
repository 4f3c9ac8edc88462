"""Best-fit packing of documents into training sequences, with conflicts.

Documents are cut into pieces of at most ``capacity`` and dealt, by the hash of
their id, over packing groups of a bounded number of documents; groups are
packed independently, so packing is as parallel as the input is large. Within a
group, pieces go from large to small. Open bins are ordered by what is left in
them; the search starts at the tightest bin that has room and goes on to its
successors until one holds neither the piece's source nor its duplicate clusters.
Each bin carries both sets as bitmaps.

Rows that repeat wholly are counted before they are shuffled and travel as one row
with a number of copies, a group's worth of copies at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
# Documents of a packing group on average; a group is what one call packs.
GROUP = 2048


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece (size, source bit, cluster bits), taken in the given order.

    ``open_bins`` is sorted by room left, then by bin number.
    """
    open_bins: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    # bins with room that hold a source: when all do, no search is needed
    holding: dict[int, int] = {}
    bins, offsets = [], []
    for size, source, cluster in pieces:
        chosen = None
        if holding.get(source, 0) < len(open_bins):
            for at in range(bisect_left(open_bins, (size, -1)), len(open_bins)):
                number = open_bins[at][1]
                if not (sources[number] & source or clusters[number] & cluster):
                    chosen = at
                    break
        if chosen is None:
            number, room = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        else:
            room, number = open_bins.pop(chosen)
            for bit in _bits(sources[number]):
                holding[bit] -= 1
        bins.append(number)
        offsets.append(capacity - room)
        sources[number] |= source
        clusters[number] |= cluster
        if room > size:
            insort(open_bins, (room - size, number))
            for bit in _bits(sources[number]):
                holding[bit] = holding.get(bit, 0) + 1
    return bins, offsets


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low
        mask ^= low


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value of the group; nulls are one value."""
    whole = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    return whole.indices.to_numpy(zero_copy_only=False)


_SCHEMA = pa.schema(
    [(name, pa.int64()) for name in ("group", "bin", "doc_id", "piece", "start", "size", "offset")]
    + [("source", pa.string()), ("cluster", pa.int64()), ("near", pa.int64())]
)


def _pack(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(name, "ascending") for name in ("doc_id", "cluster", "source", "near", "copies")])
        whole = rows["bytes"].to_numpy()
        row = np.repeat(np.arange(len(whole)), rows["copies"].to_numpy())
        counts = -(-whole[row] // capacity)
        piece = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        row = np.repeat(row, counts)
        size = np.minimum(capacity, whole[row] - piece * capacity)
        order = np.lexsort((piece, row, -size))
        row, piece, size = row[order], piece[order], size[order]

        texts, near = _codes(rows["cluster"]), _codes(rows["near"]) + 1
        near[rows["near"].combine_chunks().is_null().to_numpy(zero_copy_only=False)] = 0
        first = int(texts.max()) + 1
        clusters = [1 << t | (1 << first + n if n else 0) for t, n in zip(texts.tolist(), near.tolist())]
        sources = [1 << s for s in _codes(rows["source"]).tolist()]
        pieces = [(n, sources[r], clusters[r]) for n, r in zip(size.tolist(), row.tolist())]
        bins, offsets = best_fit(pieces, capacity)
        out = rows.select(["group", "doc_id", "source", "cluster", "near"]).take(pa.array(row))
        more = {"bin": bins, "piece": piece, "start": piece * capacity, "size": size, "offset": offsets}
        for name, values in more.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out.select(_SCHEMA.names).cast(_SCHEMA)

    return run


def packed(
    docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, classes: DataFrame | None = None
) -> DataFrame:
    """Bins for all of ``docs``, measured in UTF-8 bytes of text plus one separator.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are
    ignored. ``classes`` gives near duplicates: the ``component_id`` of a
    ``doc_id``, as from ``ngram_components``. One row per piece: ``group`` and
    ``bin`` name its bin, ``piece`` numbers the pieces of a document, ``start``
    and ``size`` are its part of the document, ``offset`` its place in the bin,
    ``cluster`` the hash of the text, ``near`` its class (null without one).

    A bin never holds more than ``capacity``, two pieces of one source (null is a
    source) or of one duplicate cluster (equal texts, and rows of one class; so no
    two pieces of one document). Documents longer than a bin are cut. A null or
    empty text has size one. Rows that repeat a doc_id are packed each, also if
    they repeat wholly. Pieces of one size are taken in the order of doc_id, text
    hash and source; among bins with equal room the one opened first is taken. An
    empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("bytes"),
    )
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    if classes is None:
        rows = rows.withColumn("near", F.lit(None).cast("bigint"))
    else:
        near = classes.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        named = rows.filter("doc_id IS NOT NULL").join(near.agg(F.min("component_id").alias("near")), "doc_id", "left")
        rows = named.unionByName(rows.filter("doc_id IS NULL").withColumn("near", F.lit(None).cast("bigint")))
    groups = max(1, -(-docs.select("doc_id").count() // group))
    last = F.floor((F.col("n") - 1) / F.lit(group)).cast("bigint")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    rows = rows.withColumn("copies", F.least(F.lit(group).cast("bigint"), F.col("n") - F.col("turn") * F.lit(group)))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", "source", "turn"), F.lit(groups)).cast("bigint"))
    rows = rows.select("group", "doc_id", "source", "cluster", "near", "bytes", "copies")
    schema = ", ".join(f"`{f.name}` {'string' if f.type == pa.string() else 'bigint'}" for f in _SCHEMA)
    return rows.groupBy("group").applyInArrow(_pack(capacity), schema)


def fill_rate(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row on the result of ``packed``: ``bins``, ``bytes`` in them and ``fill``, the share of their room in use.

    Of an empty result, ``bins`` is 0 and the others are null.
    """
    bins = pieces.groupBy("group", "bin").agg(F.sum("size").alias("held"))
    bins = bins.agg(F.count("*").alias("bins"), F.sum("held").alias("bytes"))
    return bins.withColumn("fill", F.col("bytes") / (F.col("bins") * F.lit(capacity)))
