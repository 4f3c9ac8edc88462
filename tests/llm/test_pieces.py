"""Pieces with their places: ids, spans and decoded text against the library itself."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from ledger_spark.llm import pieces as p
from ledger_spark.llm.queries import op11_offset_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", "  lead and  trail \n", "▁x ▁", "é𝄞 <s></s> <unk> <0x41>\t\x00\x01", "ﬁ ＡＢ　ｱ́ ½ x", "日本語 テキスト", "z" * 3000, "z " * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(seed, count):
    rng = random.Random(seed)
    kinds = ["a", "The", " ", "  ", "\n", "\t", "é", "ß", "𝄞", "▁", "ＡＢ", "ﬁ", "́", "½", "12", ".", " ", "　", "日", "​", "<s>", "ｶﾞ", "\r\n", "①"]
    return ["".join(rng.choice(kinds) for _ in range(rng.randrange(0, 30))) for _ in range(count)]


def test_ids_and_spans_equal_the_library(library):
    tool = p.PieceEncoder(PATH)
    texts = ODD + random_texts(1, 400)
    for text, one in zip(texts, tool.encode([t.encode() for t in texts], end=False)):
        proto = library.encode(text, return_type="proto")
        assert one.ids == [x.id for x in proto.pieces], repr(text)
        for piece, start, end in zip(proto.pieces, one.starts, one.ends):
            if piece.piece.startswith("<0x"):
                # the library puts a character's bytes on its last byte piece
                assert end == start + 1 and text.encode()[start] == int(piece.piece[3:5], 16)
            else:
                assert (start, end) == (piece.begin, piece.end), (text, piece)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
@pytest.mark.parametrize("extra", [True, False])
def test_compiled_maps(rule, extra):
    """The longest entries of real maps, with their alignment, against the library's normaliser."""
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=extra)
    rules = dict(f for number, value in p._fields(theirs.serialized_model_proto()) if number == p._NORMALIZER for f in p._fields(value))
    tool = p.PieceEncoder(PATH)
    tool.map, tool.extra = p.CharMap(rules[p._CHARSMAP]), extra
    tool.special = p.re.compile(b"[" + b"".join(p.re.escape(bytes([b])) for b in tool.map.starts) + b"]")
    for text in ODD + random_texts(2, 300):
        expected, places = theirs.normalize(text, with_offsets=True)
        got, origin = tool.normalized(text.encode())
        assert got.decode() == expected, repr(text)
        upto = [len(text[:i].encode()) for i in range(len(text) + 1)]
        ends = [0]
        for c in expected:
            ends.append(ends[-1] + len(c.encode()))
        if expected:
            assert [int(origin[e]) for e in ends] == [upto[i] for i in places], repr(text)


def expected(library, doc, text):
    ids = library.encode(text or "", out_type=int, add_eos=True)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
    return doc, len(ids), *digest


def test_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = op11_offset_pieces(spark, folder).drop("spans_crc32")
    assert sorted(tuple(x) for x in found.collect()) == sorted(expected(library, *x) for x in rows)


def test_odd_rows_and_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(p, "SLICE", 500)
    rows = [(i, t, 1) for i, t in enumerate([*ODD, None])] + [(None, "x y", 1), (3, "a", 2), (3, "a", 2), (-4, "é " * 9000, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pieces int")
    found = p.piece_report(docs, PATH).drop("spans_crc32").collect()
    assert sorted(map(tuple, found), key=repr) == sorted((expected(library, d, t) for d, t, _ in rows), key=repr)
    pieces = p.encoded(docs, PATH)
    for x, (doc, text, _) in zip(pieces.collect(), rows):
        data = (text or "").encode()
        assert x["doc_id"] == doc
        assert b"".join(data[s:e] for _, s, e in x["pieces"]) == data
    back = sorted((tuple(x) for x in p.decoded(pieces, PATH).collect()), key=repr)
    assert back == sorted(((d, library.decode(library.encode(t or ""))) for d, t, _ in rows), key=repr)
    assert p.encoded(docs.limit(0), PATH).collect() == [] and p.piece_report(docs.limit(0), PATH).collect() == []
