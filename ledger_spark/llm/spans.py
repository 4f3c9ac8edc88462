"""Positions of pattern matches, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
# Characters of text before and after a match that are kept with it.
CONTEXT = 40


# Entries of a scan that are gathered one by one; longer arrays are scanned in such blocks.
BLOCK = 256
# Characters of a text cut out at once.
CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scanned(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The merge of each entry of an array with all before it; ``merge`` is associative.

    Entries are scanned block by block and the blocks' totals on their own, so
    the growing arrays stay short and the work about linear.
    """

    def running(block: Column) -> Column:
        return F.aggregate(block, F.array(zero), lambda out, v: F.concat(out, F.array(merge(F.element_at(out, -1), v))))

    def blocks(entries: Column) -> Column:
        # no entries: one empty block
        count = F.greatest(F.ceil(F.size(entries) / F.lit(BLOCK)), F.lit(1)).cast("int")
        numbers = F.sequence(F.lit(0), count - 1)
        return F.transform(numbers, lambda b: running(F.slice(entries, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        before = running(F.transform(parts, lambda p: F.element_at(p, -1)))
        # the last of these is the total, which no block follows
        inside = F.zip_with(
            parts,
            F.slice(before, F.lit(1), F.size(parts)),
            lambda p, o: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda v: merge(o, v)),
        )
        return F.flatten(inside)

    return let(let(values, blocks), joined)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost, non-overlapping matches as structs kind, start, end, value, before, after.

    ``before`` and ``after`` are the text around a match, up to the next match
    of the same pattern. Positions count code points. The text between the matches comes from a split
    at the same pattern, so the position of a match is the length of all pieces
    and matches before it. ``pattern`` must not match an empty string. The work is
    about linear in the text and in the number of matches.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def spans(parts: Column) -> Column:
        found = parts["values"]
        number = F.size(found)
        # the piece before each match and the piece after it
        around = F.zip_with(
            F.slice(parts["pieces"], F.lit(1), number),
            F.slice(parts["pieces"], F.lit(2), number),
            lambda p, n: F.struct(
                F.char_length(p).alias("size"),
                F.right(p, F.lit(CONTEXT)).alias("before"),
                F.left(n, F.lit(CONTEXT)).alias("after"),
            ),
        )
        steps = F.zip_with(around, found, lambda a, v: a["size"] + F.char_length(v))
        ends = scanned(steps, F.lit(0), lambda x, y: x + y)
        placed = F.zip_with(found, ends, lambda v, e: F.struct(v.alias("value"), e.alias("end")))
        return F.zip_with(
            placed,
            around,
            lambda m, a: F.struct(
                F.lit(kind).alias("kind"),
                (m["end"] - F.char_length(m["value"])).alias("start"),
                m["end"].alias("end"),
                m["value"].alias("value"),
                a["before"].alias("before"),
                a["after"].alias("after"),
            ),
        )

    return let(F.struct(pieces.alias("pieces"), values.alias("values")), spans)


def cleared(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``; both have ``start`` and ``end``."""
    last = F.lit((1 << 31) - 1)

    def marked(found: Column, own: bool) -> Column:
        # the span itself comes along in spans of the first kind only
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), (s if own else F.lit(None)).alias("span")
            ),
        )

    def apart(ordered: Column) -> Column:
        reach = scanned(F.transform(ordered, lambda s: F.when(s["own"], 0).otherwise(s["end"])), F.lit(0), F.greatest)
        starts = F.reverse(F.transform(ordered, lambda s: F.when(s["own"], last).otherwise(s["start"])))
        ahead = F.reverse(scanned(starts, last, F.least))
        near = F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("reach"), a.alias("ahead")))
        free = F.zip_with(
            ordered, near, lambda s, n: F.when(s["own"] & (n["reach"] <= s["start"]) & (n["ahead"] >= s["end"]), s["span"])
        )
        return F.array_compact(free)

    mixed = F.concat(marked(spans, True), marked(others, False))
    by_start = F.array_sort(mixed, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))
    return F.when(F.size(spans) == 0, spans).when(F.size(others) == 0, spans).otherwise(let(by_start, apart))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with every span replaced by ``mask``; overlapping spans share one.

    The text is cut from chunks of bounded size, because taking a part of a string
    costs the length of what lies before it.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def cut(parts: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
        begin = F.substring(F.get(parts, first), start - first * CHUNK + 1, F.lit(CHUNK))
        whole = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        many = F.concat(begin, whole, F.left(F.get(parts, last), end - last * CHUNK))
        return F.when(end <= start, F.lit("")).when(first == last, F.left(begin, end - start)).otherwise(many)

    def built(x: Column) -> Column:
        return let(scanned(F.transform(x["spans"], lambda s: s["end"]), F.lit(0), F.greatest), lambda reach: put(x, reach))

    def put(x: Column, reach: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))

        def piece(span: Column, done: Column) -> Column:
            fresh = span["start"] >= done
            return F.when(fresh, F.concat(cut(x["chunks"], done, span["start"]), F.lit(mask))).otherwise(F.lit(""))

        rest = cut(x["chunks"], F.element_at(reach, -1), F.char_length(text))
        return F.concat(F.array_join(F.zip_with(x["spans"], before, piece), ""), rest)

    both = F.struct(chunks.alias("chunks"), ordered.alias("spans"))
    return F.when(F.size(spans) > 0, let(both, built)).otherwise(text)


def no_spans() -> Column:
    return F.array().cast(SPAN)


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans, by start and then by kind as listed, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")
        ),
    )
    texts = F.transform(
        F.array_sort(keyed),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(texts, ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
