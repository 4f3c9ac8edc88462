"""Benchmark passages, with and without other parameters, against a plain search."""

from __future__ import annotations

import duckdb
import pyarrow as pa

from ledger_spark.llm import templates as t
from ledger_spark.llm.templates import leaked_items, without_leaks

FOLDER = "/root/testdata/sf0.01"
ITEM = (
    "Anna has 12 red apples in a wide basket. Yesterday Anna gave 5 apples to her old friend Ben. "
    "How many apples does Anna still have after she bought 12 more at the market?"
)
OTHER = "A train leaves the central station at 8 and travels 240 km to the north in 3 hours without any stop."


def found(spark, docs, items=((1, ITEM), (2, OTHER))):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r for r in leaked_items(docs, items).collect()}


def test_verbatim_and_new_parameters(spark):
    swapped = ITEM.replace("Anna", "Maria").replace("12", "77").replace("Ben", "Tom").replace("5", "31").replace("apples", "apples")
    mixed = ITEM
    for k, name in enumerate(["Rosa", "Lena", "Olga"]):
        mixed = mixed.replace("Anna", name, 1)
    mixed = mixed.replace("12", "3", 1).replace("Ben", "Rosa")
    docs = [
        (1, "Some words before. " + ITEM + " And after.", None),
        (2, "some text\n" + swapped.upper().lower().replace("maria", "Maria").replace("tom", "Tom") + " end", None),
        (3, OTHER.replace("240", "90").replace("km", "miles").replace(" 8 ", " nine "), "x"),
        (4, "Nothing of the kind stands in this text, which is long enough to have windows.", None),
        (5, None, None), (6, "", None), (None, ITEM, None), (7, "word " * 50_000 + ITEM, None),
        (8, mixed, None),
    ]
    got = found(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (7, 1)}
    assert got[1, 1]["same_values"] and got[1, 1]["coverage"] == 1.0
    assert not got[2, 1]["same_values"] and got[2, 1]["agreement"] >= 0.8


def test_odd_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, ITEM, None)], []) == {}
    got = found(spark, [(1, ITEM, None), (1, ITEM, None)], [(4, ITEM), (3, ITEM.upper().lower()), (9, None), (None, ITEM), (5, "two"), (6, ITEM)])
    assert set(got) == {(1, 4)} or set(got) == {(1, 3), (1, 4)}


def test_items_of_one_template_are_compared_each(spark):
    one = "He packs {} boxes of blue ink, then {} pens of the best kind, then {} caps for the whole class."
    items = [(1, one.format(3, 3, 3)), (2, one.format(4, 6, 9)), (3, one.format(4, 6, 9))]
    got = found(spark, [(1, "Read this. " + one.format(4, 6, 9), None)], items)
    assert set(got) == {(1, 2)}
    assert got[1, 2]["same_values"] and got[1, 2]["coverage"] == 1.0


def test_changes_of_the_word_count(spark):
    item = (
        "The bakery at our corner sells warm bread for 5 coins and Anna buys some of it every "
        "single morning before work, while her quiet neighbour carries 3kg of flour home to bake there."
    )
    longer = item.replace("Anna", "Mary Ann Miller").replace(" 5 ", " twenty five ").replace("3kg", "40 kg")
    middle = item.replace("some of it", "quite some of it")
    twice = item.replace("warm bread", "warm fresh bread").replace("quiet neighbour", "quiet old neighbour")
    spread = item.replace("every single", "every, as I heard from them a few days ago, single")
    opened = "Anna went out. Ben sang to us. Anna took a big cup of tea. Ben ate all the cake. Anna left the room then."
    other = opened.replace("Anna", "Mary Ann").replace("Ben", "Tom")
    docs = [(k, "It says so here. " + text + " So it ends.", None) for k, text in enumerate([longer, middle, twice, spread, other])]
    got = found(spark, docs, [(1, item), (2, opened)])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)}
    assert not got[0, 1]["same_values"] and got[1, 1]["same_values"] and got[2, 1]["same_values"]


def test_items_with_few_ordinary_words(spark):
    items = [
        (1, "Compute 17 + 23 * 45 - 12"), (2, "Anna Ben Carla Dora Emil Franz Gerda Hans Ida Jan Karl Lena"),
        (3, "price 4 5 6 7 8 9 10 11 12 13 14 15 km"), (4, "two"),
    ]
    docs = [(k, f"Here Otto says 3 {text} 8 Maria and two more words.", None) for k, text in items]
    docs += [(5, "Compute 18 + 23 * 45 - 12 and more", None), (6, "Here is Anna Ben Carla Emil Dora Franz", None), (7, "price 9 8 7 6 5 4 3 2 1 9 8 7 6 km", None)]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3)}
    assert all(r["same_values"] and r["coverage"] == 1.0 for r in got.values())


def test_whole_tables_against_plain_search(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, items).collect()}
    want = duckdb.sql(
        f"SELECT doc_id, item_id FROM '{FOLDER}/documents.parquet' d, '{FOLDER}/benchmark.parquet' b WHERE contains(d.text, b.text)"
    ).fetchall()
    assert want and set(want) <= got
    assert {d for d, _ in got} == {d for d, _ in want}
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - {d for d, _ in want}


def test_plain_words_are_read_like_all_others(monkeypatch):
    """The short way for small letters gives what the general one gives."""
    words = "the one, kg. word word. word, word; word: word?! word... éa Word wor-d word's (word word) x2 5kg hundred".encode().split()
    short = t.Canonical()
    numbers = [short.numbers(b" ".join(words))]
    monkeypatch.setattr(t, "_LISTED", frozenset(w.decode().rstrip(".,;:!?").lower() for w in words))
    general = t.Canonical()
    numbers.append(general.numbers(b" ".join(words)))
    assert (numbers[0] == numbers[1]).all()
    assert all((a == b).all() for a, b in zip(short.table(), general.table()))


def test_slices_give_the_same_result(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted(map(tuple, t.leaked_items(docs, items).collect()))
    monkeypatch.setattr(t, "SLICE", 3000)
    monkeypatch.setattr(t, "MEMO_WORDS", 200)
    assert sorted(map(tuple, t.leaked_items(docs, items).collect())) == whole and whole


def test_new_words_are_read_at_once(spark, monkeypatch):
    """Neither words that occur once nor documents are read one by one."""
    letters = [chr(97 + k // 676) + chr(97 + k // 26 % 26) + chr(97 + k % 26) for k in range(2000)]
    words = [w + end for w, end in zip(letters, ["", ".", "$$$", "é", "É,", "-x"] * 400)]
    memo = t.Canonical()
    assert len(memo.numbers(" ".join(words).encode())) == 2000 and not memo
    memo.numbers(b"plain (word) 5kg 5kg one")
    assert set(memo) == {b"(word)", b"5kg", b"one"}

    calls, canonical = [], t.canonical
    monkeypatch.setattr(t, "canonical", lambda *given: calls.append(1) or canonical(*given))
    monkeypatch.setattr(t, "SLICE", 40_000)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [" ".join(words[:20])] * 1000})
    found = pa.Table.from_batches(t._doc_windows(None, [(0, 8)])(iter([batch])))
    assert len(calls) <= 4
    assert found["doc_id"].to_pylist() == [k for k in range(1000) for _ in range(13)]
    assert found["at"].to_pylist() == list(range(13)) * 1000


def test_signs_and_latin_letters_are_read_like_all_others(monkeypatch):
    words = "été Été. ÉTÉ É é, Éa a×b ×a ÷ ÿ Þa ß don't Don't wor-D $Word$ word.$$$ word,### _a_ -- .a? kg$$ (one --a!! Éte; x".encode().split()
    words += [b"\xc3", b"a\xc3", b"\xc3a", b"a\x89", b"a\xffb", b"word" * 500]
    short = t.Canonical()
    short.numbers(b" ".join(words))
    kinds, ends, stops = (short.table()[k].tolist() for k in (1, 3, 4))
    general = [t._read(word) for word in words]
    assert (kinds, ends, stops) == tuple([row[k] for row in general] for k in (1, 3, 4))
    lows = [row[0] or None for row in general]
    values = [value if low else None for value, low in zip(short.table()[0].tolist(), lows)]
    assert len(set(zip(lows, values))) == len(set(lows)) == len(set(values))


def test_windows_end_with_their_text(spark):
    words = OTHER.split()
    halves = [" ".join(words[:10]), " ".join(words[10:])]
    texts = [half for k in range(20) for half in halves] + [None, "", OTHER, "", OTHER]
    got = found(spark, [(k, text, None) for k, text in enumerate(texts)], [(1, OTHER)])
    assert set(got) == {(42, 1), (44, 1)}
