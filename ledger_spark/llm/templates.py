"""Benchmark passages in documents, also with other numbers, names and units.

Words become canonical tokens: numbers, units and names turn into typed
placeholders, other words are lower-cased and lose outer punctuation. Neighbours
of one type are one placeholder, so a name or number may get more words. Every
text has two such forms, because a capitalised word that opens a sentence may or
may not be a name, and a form of its real words, in which exact copies are found
however few ordinary words they hold. Windows of tokens of documents and benchmark items meet in a hash
join, form by form. Windows on close alignments (document position minus item
position) of a document and an item are counted together, and the values in
their slots are compared: a re-parameterised copy replaces each value in the same
way wherever it stands.
"""

from __future__ import annotations

import re
import string
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.hashing import mix, texts, windows, word_hashes
from ledger_spark.llm.ngram_join import only_ids
from ledger_spark.staging import stage

WINDOW = 8
# Words of a window with placeholders, or of a shorter item, that must be literal;
# and words of any kind that an item must have to be looked for in its exact form.
LITERALS = 4
# A copy counts from this share of the item's windows.
COVERAGE = 0.5
# Share of slots that must follow one replacement of values (or be unchanged).
AGREEMENT = 0.8
# Benchmark windows up to which documents' windows are filtered before the join.
FILTER_WINDOWS = 1_000_000
FILTER_BITS = 22
MEMO_WORDS = 400_000
# Bytes of text canonicalised at once.
SLICE = 2 << 20

# Spelled numbers and units of measure.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion dozen"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years cent cents dollar dollars euro euros percent degree degrees "
    "meter meters metre metres gram grams kilogram kilograms kilometer kilometers mph kmh"
).split()

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|[a-z]{1,3})?$")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_END = re.compile(r"[.!?:][\"')\]]*$")
_STOP = re.compile(r"[.!?:,;)\]]+[\"']*$")
_WORD, _NUM, _UNIT, _CAP = range(4)
_PLACES = np.array([0, 11, 13, 17], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


_TABLE = (np.uint64, np.int8, np.uint64, bool, bool)
_LISTED = frozenset([*NUMBERS, *UNITS])
# Which bytes are blanks between words, letters, capitals, digits, quotes or brackets behind
# a word, and marks that end a sentence or a part of one.
_BLANK, _LETTER, _UPPER, _DIGIT, _CLOSING, _ENDS, _STOPS = (
    np.isin(np.arange(256), list(some.encode()))
    for some in (" \t\n\r\v\f", string.ascii_letters, string.ascii_uppercase, string.digits, "\"')]", ".!?:", ".!?:,;")
)
# First byte of the letters of Latin-1, and which second bytes are letters and capitals.
_LATIN = 0xC3
_SECOND, _CAPITAL = (np.isin(np.arange(256), [n for n in range(0x80, end) if n not in (0x97, 0xB7)]) for end in (0xC0, 0x9F))


class Canonical(dict):
    """Hash, kind, glued unit and ending of the words of a text, which may be many texts joined.

    Words of letters, perhaps with other signs but digits in or around them, are read all
    at once from the text's bytes. Others are read one by one and remembered, in one table
    for each task; ``start`` empties a full one.
    """

    def __init__(self):
        super().__init__()
        self.known = self.arrays = tuple(np.zeros(0, kind) for kind in _TABLE)
        self.begins = np.zeros(0, np.int64)

    def start(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()
            self.known = tuple(np.zeros(0, kind) for kind in _TABLE)

    def numbers(self, text: bytes) -> np.ndarray:
        """Number of each word of a text in ``table``; words end at ASCII white space."""
        text += b" "
        first, last, columns, plain = _plain(text)
        odd = np.flatnonzero(~plain)
        words = [text[a:b] for a, b in zip(first[odd].tolist(), last[odd].tolist())]
        self._learn(list(dict.fromkeys(word for word in words if word not in self)))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        for column, known in zip(columns, self.known):
            column[odd] = known[at]
        self.arrays, self.begins = columns, first
        return np.arange(len(first))

    def numbers_of_all(self, many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of every word of all texts in order, and the place of its text."""
        at = self.numbers(b" ".join(many))
        ends = np.cumsum([len(text) + 1 for text in many])
        return at, np.searchsorted(ends, self.begins, "right")

    def table(self) -> tuple[np.ndarray, ...]:
        """Properties of the words of the last text."""
        return self.arrays

    def _learn(self, new: list[bytes]) -> None:
        if not new:
            return
        lows, kinds, units, ends, stops = zip(*map(_read, new))
        value, unit = (_hashes(" ".join(part or "-" for part in parts).encode()) for parts in (lows, units))
        unit[[not part for part in units]] = 0
        self.update(zip(new, range(len(self), len(self) + len(new))))
        columns = (value, kinds, unit, ends, stops)
        self.known = tuple(np.r_[known, np.array(column, known.dtype)] for known, column in zip(self.known, columns))


def _hashes(words: bytes) -> np.ndarray:
    return word_hashes([words])[0] | np.uint64(1)


def _plain(data: bytes) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Where the words of ``data`` begin and end, their properties, and which of them were read.

    Left out are words without letters, with digits, letters beyond Latin-1 or a quote or
    bracket at the end, and numbers and units in words. ``data`` ends with a blank.
    """
    flat = np.frombuffer(data, np.uint8)
    inside = ~_BLANK[flat]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    first, last = edges[::2], edges[1::2]
    letter, upper, other = _LETTER[flat], _UPPER[flat], _DIGIT[flat]
    # letters of Latin-1 have two bytes, the second of a small one is 32 higher
    high = np.flatnonzero(flat > 127)
    lead = high[(flat[high] == _LATIN) & _SECOND[flat[np.minimum(high + 1, len(flat) - 1)]]]
    letter[lead] = letter[lead + 1] = True
    upper[lead] = _CAPITAL[flat[lead + 1]]
    other[high] = ~letter[high]
    low = flat.copy()
    low[lead[upper[lead]] + 1] += 32

    letters, uppers = np.r_[0, np.cumsum(letter)], np.r_[0, np.cumsum(upper)]
    plain = (letters[last] > letters[first]) & ~_CLOSING[flat[last - 1]]
    plain[np.searchsorted(first, np.flatnonzero(other), "right") - 1] = False
    read = np.flatnonzero(plain)
    # without the signs around them
    places = np.flatnonzero(letter)
    begin, end = places[letters[first[read]]], places[letters[last[read]] - 1] + 1
    step = np.zeros(len(flat) + 1, np.int8)
    step[begin], step[end] = 1, -1
    low[np.cumsum(step[:-1], dtype=np.int8) == 0] = 32
    hashes = _hashes(low.tobytes())
    listed = np.sort(_hashes(" ".join(_LISTED).encode()))
    ours = listed[np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)] != hashes
    plain[read[~ours]] = False

    columns = tuple(np.zeros(len(first), kind) for kind in _TABLE)
    values, kinds, _, ends, stops = columns
    capital = upper[begin] & (uppers[last[read]] - uppers[first[read]] == 1) & (end - begin > 1 + (flat[begin] > 127))
    values[read], kinds[read] = hashes, np.where(capital, _CAP, _WORD)
    ends[read], stops[read] = _ENDS[flat[last[read] - 1]], _STOPS[flat[last[read] - 1]]
    return first, last, columns, plain


def _read(raw: bytes) -> tuple[str, int, str, bool, bool]:
    """A word in small letters, its kind, its glued unit, and whether a sentence or a part of one ends behind it."""
    word = raw.decode("utf-8", "replace")
    core = word.rstrip(".,;:!?")
    if core.isalpha() and (low := core.lower()) not in _LISTED:
        # letters, perhaps with a mark behind them: a word or a name
        kind = _CAP if len(core) > 1 and core[0].isupper() and core[1:].islower() else _WORD
        return low, kind, "", word[-1] in ".!?:", core != word
    bare = _EDGE.sub("", word)
    low = bare.lower()
    number = _NUMBER.match(word.strip("\"'()[]{}.,;:!?").lower())
    unit = ""
    if not bare:
        kind = -1
    elif number or low in NUMBERS:
        kind = _NUM
        if number and number[1] and (number[1] == "%" or number[1] in UNITS):
            unit = number[1]
            low = low.removesuffix(unit)
    elif low in UNITS:
        kind = _UNIT
    elif len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        kind = _CAP
    else:
        kind = _WORD
    return low, kind, unit, bool(_END.search(word)), bool(_STOP.search(word))


# Token hashes and slot values of one or more texts, and the place of each token's text.
Form = tuple[np.ndarray, np.ndarray, np.ndarray]


def canonical(at: np.ndarray, place: np.ndarray, table) -> list[Form]:
    """The forms of some texts, from their word numbers and the place of each word's text.

    The first form has no slots. In the others a capitalised word is a name; where
    it starts the text or a sentence it is an ordinary word in the second form and
    a name in the third.
    """
    values, kinds, units, ends, stops = table
    kind, value, unit, end = kinds[at], values[at], units[at], stops[at]
    opens = (kind == _CAP) & (np.r_[True, ends[at[:-1]]][: len(at)] | _begins(place))
    glued = np.flatnonzero(unit)
    if len(glued):
        # a number with a unit becomes two tokens
        kind, opens = np.insert(kind, glued + 1, _UNIT), np.insert(opens, glued + 1, False)
        value, end = np.insert(value, glued + 1, unit[glued]), np.insert(end, glued, False)
        place = np.insert(place, glued + 1, place[glued])
    real = np.flatnonzero(kind >= 0)
    kind, value, opens, place = kind[real], value[real], opens[real], place[real]
    apart = _begins(place)
    apart[1:] |= end[real[:-1]] | (np.diff(real) > 1)
    exact = value, np.zeros(len(value), np.uint64), place
    return [exact, _merged(np.where(opens, _WORD, kind), value, apart, place), _merged(kind, value, apart, place)]


def _begins(place: np.ndarray) -> np.ndarray:
    """Whether each place differs from the one before it."""
    begins = np.ones(len(place), bool)
    begins[1:] = place[1:] != place[:-1]
    return begins


def _merged(kind: np.ndarray, value: np.ndarray, apart: np.ndarray, place: np.ndarray) -> Form:
    """One token for each run of placeholders of one type that no punctuation divides."""
    slot = kind > 0
    tokens = np.where(slot, _PLACES[kind], value)
    joins = np.zeros(len(kind), bool)
    joins[1:] = slot[1:] & (kind[1:] == kind[:-1]) & ~apart[1:]
    if joins.any():
        first = np.flatnonzero(~joins)
        inside = np.arange(len(kind)) - np.repeat(first, np.diff(np.r_[first, len(kind)]))
        value = np.where(joins, mix(value + inside.astype(np.uint64) * _PLACES[1]), value)
        value, tokens, slot, place = np.add.reduceat(value, first), tokens[first], slot[first], place[first]
    return tokens, np.where(slot, value, np.uint64(0)), place


def _windows(form: int, tokens: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Window hashes, whether each has enough literals, and the window length.

    Without slots every word is a literal, so the exact form of an item of
    ``LITERALS`` words or more has all its windows.
    """
    size = min(WINDOW, len(tokens))
    if not size:
        return tokens, np.zeros(0, bool), 0
    literal = np.r_[0, np.cumsum(slots == 0)]
    return _keys(form, tokens, size), literal[size:] - literal[:-size] >= LITERALS, size


def _keys(form: int, tokens: np.ndarray, size: int) -> np.ndarray:
    """Window hashes; those of different forms never meet."""
    return windows(tokens, size) + np.uint64(form) * _PLACES[3]


def _as_signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Canonical()
    for items, data in (part for batch in batches for part in _slices(batch)):
        memo.start()
        out = {n: [] for n in _ITEM_ARROW.names}
        at, place = memo.numbers_of_all(data)
        whole = canonical(at, place, memo.table())
        bounds = [np.searchsorted(place, np.arange(len(items) + 1)).tolist() for *_, place in whole]
        for k, item in enumerate(items):
            forms = [(tokens[b[k] : b[k + 1]], slots[b[k] : b[k + 1]]) for (tokens, slots, _), b in zip(whole, bounds)]
            version = xxhash.xxh3_64_intdigest(b"".join(part.tobytes() for form in forms for part in form)) - (1 << 63)
            for form, (tokens, slots) in enumerate(forms):
                keys, usable, size = _windows(form, tokens, slots)
                good = np.flatnonzero(usable)
                for i in good.tolist():
                    out["item_id"].append(item)
                    out["version"].append(version)
                    out["form"].append(form)
                    out["n"].append(len(good))
                    out["length"].append(len(tokens))
                    out["at"].append(i)
                    out["key"].append(int(_as_signed(keys)[i]))
                    out["slots"].append(_as_signed(slots[i : i + size]).tolist())
        yield pa.RecordBatch.from_pydict(out, _ITEM_ARROW)


_ITEM_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("item_id", "version", "form", "n", "length", "at", "key")] + [("slots", pa.list_(pa.int64()))]
)
_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("slots", pa.list_(pa.int64()))])


def _probes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts of a batch, ``SLICE`` bytes or one text at a time."""
    docs, data, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
        docs.append(doc)
        data.append(text or b"")
        size += len(data[-1])
        if size >= SLICE:
            yield docs, data
            docs, data, size = [], [], 0
    if docs:
        yield docs, data


def _doc_windows(filters, sizes):
    """Windows of documents that the benchmark may hold.

    ``sizes`` are the forms and window lengths of the benchmark: the usual
    length, and those of items that are shorter than it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Canonical()
        seen = None
        if filters is not None:
            seen = np.zeros(1 << FILTER_BITS, bool)
            for probe in _probes(np.frombuffer(filters.value, np.uint64)):
                seen[probe] = True
        for batch in batches:
            for docs, data in _slices(batch):
                memo.start()
                at, place = memo.numbers_of_all(data)
                forms = canonical(at, place, memo.table())
                ids = pa.array(docs, pa.int64())
                for form, size in sizes:
                    tokens, slots, place = forms[form]
                    if len(tokens) < size:
                        continue
                    keys = _keys(form, tokens, size)
                    hit = np.arange(len(keys))
                    if seen is not None:
                        one, two = _probes(keys)
                        hit = np.flatnonzero(seen[one])
                        hit = hit[seen[two[hit]]]
                    # no window reaches into the next text
                    hit = hit[place[hit] == place[hit + size - 1]]
                    if not len(hit):
                        continue
                    inside = np.lib.stride_tricks.sliding_window_view(_as_signed(slots), size)[hit].ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(place[hit])),
                            pa.array(hit - np.searchsorted(place, place[hit])),
                            pa.array(_as_signed(keys[hit])),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1, dtype=np.int32) * np.int32(size)), pa.array(inside)),
                        ],
                        schema=_DOC_ARROW,
                    )

    return run


_PAIR = ["doc_id", "item_id", "version", "form", "n", "length"]
_BEST = "doc_id bigint, item_id bigint, n_windows bigint, coverage double, agreement double, same_values boolean"
_BEST_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64())]
    + [("coverage", pa.float64()), ("agreement", pa.float64()), ("same_values", pa.bool_())]
)


def _agreement(slots: list[tuple[int, int]]) -> tuple[float, bool]:
    """Share of slots that fit one replacement, or are unchanged, and whether all are unchanged."""
    if not slots:
        return 1.0, True
    there, back = {}, {}
    for x, y in slots:
        there.setdefault(x, []).append(y)
        back.setdefault(y, []).append(x)
    most = lambda v: max(map(v.count, set(v)))
    fits = min(sum(map(most, there.values())), sum(map(most, back.values())))
    equal = sum(x == y for x, y in slots)
    return max(fits, equal) / len(slots), equal == len(slots)


class _Copies:
    """Best copy of one form of an item in a document, from their common windows by ascending shift.

    A copy with inserted or left-out words lies on several alignments. Around each
    alignment the windows that it misses are taken from the others, nearest first,
    that are not further off than the item is long; only those are held.
    """

    def __init__(self, n: int, length: int):
        self.n, self.spread = n, max(length, WINDOW)
        self.lines: deque[tuple[int, dict[int, tuple[list[int], list[int]]]]] = deque()
        self.next = 0
        self.best: tuple[float, float, bool, int] | None = None

    def add(self, shift: int, at: int, item_slots: list[int], doc_slots: list[int]) -> None:
        if not self.lines or self.lines[-1][0] != shift:
            self.settle(shift)
            self.lines.append((shift, {}))
        self.lines[-1][1].setdefault(at, (item_slots, doc_slots))

    def settle(self, shift: int | None = None) -> None:
        """Judge the alignments to which windows from ``shift`` on add nothing."""
        while self.next < len(self.lines) and (shift is None or self.lines[self.next][0] + self.spread < shift):
            base = self.lines[self.next][0]
            while self.lines[0][0] < base - self.spread:
                self.lines.popleft()
                self.next -= 1
            self._judge(base)
            self.next += 1

    def _judge(self, base: int) -> None:
        if self.best is not None and self.best[0] == 1.0 and self.best[2]:
            return
        near = [line for line in self.lines if abs(line[0] - base) <= self.spread]
        if sum(len(found) for _, found in near) < COVERAGE * self.n:
            return
        places: set[int] = set()
        slots: dict[int, tuple[int, int]] = {}
        for _, found in sorted(near, key=lambda line: (abs(line[0] - base), line[0])):
            new = found.keys() - places
            places |= new
            for at in sorted(new):
                for k, (x, y) in enumerate(zip(*found[at])):
                    if x or y:
                        slots.setdefault(at + k, (x, y))
            if new and len(places) >= COVERAGE * self.n:
                share, same = _agreement(list(slots.values()))
                if share >= AGREEMENT:
                    now = len(places) / self.n, share, same, len(places)
                    self.best = now if self.best is None else max(self.best, now)
            if len(places) == self.n:
                break


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best copy of each document, item and form; input sorted by them and the shift."""
    pair, copies = None, None
    for batch in batches:
        out = []
        for *now, shift, at, item_slots, doc_slots in zip(*(c.to_pylist() for c in batch.columns)):
            if now != pair:
                out += _closed(pair, copies)
                pair, copies = now, _Copies(now[4], now[5])
            copies.add(shift, at, item_slots, doc_slots)
        yield pa.RecordBatch.from_pylist(out, _BEST_ARROW)
    yield pa.RecordBatch.from_pylist(_closed(pair, copies), _BEST_ARROW)


def _closed(pair: list[int] | None, copies: _Copies | None) -> list[dict]:
    if copies is None:
        return []
    copies.settle()
    if copies.best is None:
        return []
    coverage, share, same, n = copies.best
    return [dict(zip(_BEST_ARROW.names, (pair[0], pair[1], n, coverage, share, same)))]


def leaked_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold benchmark items.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and
    ``text``; other columns are ignored. One row per document and item:
    ``doc_id``, ``item_id``, ``n_windows`` and ``coverage`` (windows found of
    the best copy, and their share of the item's; at least ``COVERAGE``), ``agreement`` (of slots) and
    ``same_values`` (no slot was changed). Items with equal canonical text and
    equal values count as one, under the smallest item_id; items that differ in a
    value are compared each. Items with fewer than ``LITERALS``
    words of any kind (signs alone are none), null texts and rows without ids match nothing; rows that
    repeat a doc_id count as one document; empty tables give no rows.
    """
    spark = docs.sparkSession
    schema = "item_id bigint, version bigint, form bigint, n bigint, length bigint, at bigint, key bigint, slots array<bigint>"
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").filter("item_id IS NOT NULL")
    items = items.mapInArrow(_item_windows, schema)
    first = items.groupBy("version").agg(F.min("item_id").alias("item_id"))
    items = stage(items.join(first, ["version", "item_id"], "left_semi").distinct(), "items")
    sizes = [tuple(r) for r in items.select("form", F.size("slots")).distinct().collect()]
    filters = None
    if items.limit(FILTER_WINDOWS + 1).count() <= FILTER_WINDOWS:
        keys = [r[0] for r in items.select("key").distinct().collect()]
        filters = spark.sparkContext.broadcast(np.array(keys, np.int64).tobytes())

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    found = chosen.mapInArrow(_doc_windows(filters, sizes), "doc_id bigint, at bigint, key bigint, slots array<bigint>")
    right = items.select("key", *_PAIR[1:], F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    both = found.join(right, "key").withColumn("shift", F.col("at") - F.col("item_at"))
    both = both.select(*_PAIR, "shift", "item_at", "item_slots", F.col("slots").alias("doc_slots"))
    both = both.repartition("doc_id", "item_id").sortWithinPartitions(*_PAIR, "shift", "item_at")
    best = both.mapInArrow(_copies, _BEST).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("coverage", "agreement", "same_values", "n_windows")).alias("m")
    )
    return best.select("doc_id", "item_id", "m.n_windows", "m.coverage", "m.agreement", "m.same_values")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no benchmark item.

    Rows without doc_id stay.
    """
    leaked = stage(leaked_items(docs, benchmark).select("doc_id").distinct(), "leaked")
    return only_ids(docs, leaked, "left_anti").select(*docs.columns)
