"""Record files: round trip against the tokenizer itself, damage, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledger_spark.llm import records as r

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tool = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = tool.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(row):
    return row[1]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(x) for x in r.record_report(docs, PATH).collect()), key=key)
    assert got == expected([tuple(x) for x in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (1, " a  b \n\n c"), (1, " a  b \n\n c"), (None, "é𝄞 <|endoftext|> x\t y"), (9, "z " * 60_000), (-4, "  lead and trail  ")]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id bigint, text string, start int")
    got = sorted((tuple(x) for x in r.record_report(docs, PATH).collect()), key=key)
    assert got == expected(rows)
    assert r.record_report(docs.limit(0), PATH).collect() == []


def test_pieces_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(r, "MEMO_PIECES", 50)
    tool, encoder, rng = Tokenizer.from_file(PATH), r.Encoder(PATH), random.Random(4)
    for _ in range(60):
        texts = ["".join(rng.choice(["a", "The", "'s", "12", " ", "  ", "\n", "\t", " ", "é", ".", "!?", "\x1c", " "]) for _ in range(rng.randrange(0, 25))) for _ in range(20)]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == tool.encode(text, add_special_tokens=False).ids, repr(text)


def test_any_order_and_damage(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder, manifest = r.write_records(docs, PATH, str(tmp_path / "out"))
    for m in manifest.collect():
        file = r.RecordFile(folder, m["file"], m["width"])
        whole = list(file.records())
        assert len(whole) == len(file) == m["n_records"] and sum(len(i) for _, i in whole) == m["n_tokens"]
        for n in random.Random(1).sample(range(len(file)), len(file)):
            doc, ids = file.record(n)
            assert doc == whole[n][0] and (ids == whole[n][1]).all()
    name = tmp_path / "out" / f"{m['file']}.rec"
    data = bytearray(name.read_bytes())
    data[20] ^= 1
    name.write_bytes(data)
    with pytest.raises(ValueError):
        r.RecordFile(folder, m["file"], m["width"]).record(0)


def test_many_rows_of_one_id_are_spread(spark):
    rows = [(7, f"{i % 50} text") for i in range(3000)] + [(7, "same")] * 3000 + [(None, None)] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    try:
        folder, manifest = r.write_records(docs, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = manifest.collect()
    assert len(files) > 2 and max(f["n_records"] for f in files) < 4000
    got = sorted((tuple(x) for x in r.read_digests(folder, manifest).collect()), key=key)
    want = expected(rows)
    assert sorted((d or -1, n, c) for d, _, n, c in got) == sorted((d or -1, n, c) for d, _, n, c in want)
    at = 0
    for doc, start, count, _ in got:
        assert start == at
        at += count
    assert [d for d, *_ in got] == [d for d, *_ in want]


def test_ranges_of_a_file(spark, monkeypatch):
    monkeypatch.setattr(r, "RANGE_BYTES", 300)
    rows = [(i, f"text number {i} " * (i % 90)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder, manifest = r.write_records(docs, PATH)
    found = r.read_digests(folder, manifest)
    assert found.rdd.getNumPartitions() >= sum(-(-f["n_bytes"] // 300) for f in manifest.collect())
    assert sorted((tuple(x) for x in found.collect()), key=key) == expected(rows)


def test_strays_are_removed(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b") for i in range(40)], "doc_id bigint, text string")
    folder, manifest = r.write_records(docs, PATH, str(tmp_path / "out"))
    (tmp_path / "out" / "part-000000-left.rec").write_bytes(b"half")
    assert r.remove_strays(folder, manifest) == 1 and r.remove_strays(folder, manifest) == 0
    assert r.read_digests(folder, manifest).count() == 40


def test_new_pieces_are_encoded_together(monkeypatch):
    tool, rng = r.Encoder(PATH), random.Random(6)
    seen, encode = [], tool._ids
    monkeypatch.setattr(tool, "_ids", lambda texts: seen.append(len(texts)) or encode(texts))
    texts = [" ".join("".join(rng.choices("abcdeé.,'1", k=9)) for _ in range(700)) for _ in range(3)]
    plain = tool.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in tool.encode(texts)] == [e.ids for e in plain]
    # only the first pieces of the texts, and the runs of marks, were encoded each
    assert sum(seen) == len(texts) + len(tool.marks) < 200


def test_pieces_that_do_not_stand_between_spaces():
    tool = r.Encoder(PATH)
    odd = ["", "a\n", "b  c", "ok", "<|endoftext|>", "\x1c", "it's", "é𝄞", "x\ty"]
    plain = tool.tokenizer.encode_batch([" " + p for p in odd], add_special_tokens=False)
    assert {p: np.frombuffer(ids, "<u2").tolist() for p, ids in tool._of_pieces(odd)} == {p: e.ids for p, e in zip(odd, plain)}


def test_marks_behind_words():
    tool, rng = r.Encoder(PATH), random.Random(9)
    ends = ["", ",", "'", "...", "'s", "'s,", "$)", "|>", "<|endoftext|>", "_", "é,", "²!", "\u0301.", "\U0001d11e?", "\u2019,", "\n.", "\x1c,"]
    texts = [" ".join(rng.choice(["", "a", "word", "12", "été", "x-y", "don't"]) + rng.choice(ends) for _ in range(60)) for _ in range(200)]
    plain = tool.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in tool.encode(texts)] == [e.ids for e in plain]


def test_each_different_word_is_remembered_once():
    tool, rng = r.Encoder(PATH), random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(40)]
    texts = ["\n".join(" ".join(rng.choices(words, k=6)) + rng.choice([".", "!?", ","]) for _ in range(100)) for _ in range(20)]
    plain = tool.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in tool.encode(texts)] == [e.ids for e in plain]
    # behind a space, behind a line end or at a start; not each pair of words around a line end
    assert len(tool.pieces.young) <= 3 * len(words) + 3


def test_slices_of_a_column(monkeypatch):
    odd = ["a", "Word", "'s", "12", " ", "  ", "\n", "\r\n", "\xa0", "\x85", "\u2003", "\u2028", "\u3000", "é", "×", "²", "ɐ", ".", "!?", "\x1c", "<|endoftext|>", "|>", "中", "\U0001d11e", "\u0301"]
    tool, rng = r.Encoder(PATH), random.Random(5)
    for size in (1, 30, 1_000_000):
        monkeypatch.setattr(r, "SLICE", size)
        monkeypatch.setattr(r, "CALL", size)
        for kind in (pa.string(), pa.large_string()):
            texts = ["".join(rng.choices(odd, k=rng.randrange(0, 25))) for _ in range(400)]
            found = list(tool.in_slices(pa.array(["before", *texts, "after"], kind).slice(1, len(texts))))
            plain = tool.tokenizer.encode_batch(texts, add_special_tokens=False)
            assert [(n, np.frombuffer(ids, "<u2").tolist()) for n, ids in found] == list(enumerate(e.ids for e in plain))


def test_long_pieces_are_not_remembered():
    tool = r.Encoder(PATH)
    text = "中" * 5000 + " word " + "x" * 5000 + "!" * 5000
    for _ in range(2):
        assert np.frombuffer(tool.encode([text])[0], "<u2").tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids
    assert list(tool.pieces.young) == [" word"] and not tool.marks


def test_many_added_tokens():
    tool = r.Encoder(PATH)
    texts = ["a<|endoftext|> b, " * 60_000, "end<|endoftext|>|>, x"]
    found = tool.encode(texts)
    plain = tool.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in found] == [e.ids for e in plain]
