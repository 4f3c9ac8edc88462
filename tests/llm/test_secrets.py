"""Secret spans against plain patterns, and the trigram queries."""

from __future__ import annotations

import hashlib
import random
import re
import time

from ledger_spark.llm import secrets as s

FOLDER = "/root/testdata/sf0.01"
BASE = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def check(rows, got):
    want = {}
    for doc, text in rows:
        spans = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        counts = tuple(sum(k == kind for *_, k in spans) for kind, _ in BASE)
        want.setdefault(doc, []).append((*counts, hashlib.sha256(joined.encode()).hexdigest(), set(filter(None, joined.split(",")))))
    for r in got:
        options = want[r["doc_id"]]
        assert any(tuple(r)[1:5] == o[:4] and o[4] <= set(r["spans"].split(",")) for o in options), (r, options)
    assert len(got) == len(rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = s.secret_report(docs).collect()
    check(rows, got)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got) > 5


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, 'é 𝄞 Token = "abcdefgh" and PASSWD:short and api_key=\'12345678\''),
        (3, "AKIA" + "A" * 12 + " AKIAshort " + "f" * 31 + " " + "0" * 40), (None, "secret : x.y-z_0=1"),
        (5, "token==abcdefgh password=\"password=12345678\""), (6, "deadbeef" * 20_000 + " token: " + "a" * 50_000),
        (7, "ghp_" + "aZ" * 18 + " xoxb-1234567890 postgres://me:hunter22@db -----BEGIN RSA PRIVATE KEY-----"),
        (8, " ".join(f"token=abcdefgh{i}" for i in range(3000))),
    ]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, secret_spans int")
    got = s.secret_report(docs).collect()
    check(rows, got)
    more = next(r["spans"] for r in got if r["doc_id"] == 7)
    assert {x.split(":")[0] for x in more.split(",")} == {"code_host", "chat", "login_url", "private_key"}
    assert s.secret_report(docs.limit(0)).collect() == []


def test_queries_are_sound():
    assert s.clauses(r"[0-9a-f]+") == s.clauses(s.BASE_RULES[2].pattern) == []
    assert s.clauses(r"AKIA[A-Z0-9]+") == s.clauses(s.BASE_RULES[1].pattern) == [{"akia"}]
    words = {"password", "passwd", "secret", "token", "api_key", "apikey"}
    assert s.clauses(s.BASE_RULES[0].pattern)[0] == {w + q for w in words for q in ("", "'", '"')}
    assert s.clauses(r"ab?cd[xy]ef\d+ghi") == [{"abcdxef", "acdxef", "abcdyef", "acdyef"}, {"ghi"}]
    assert s.clauses(r"(?:abc)*de") == []


def test_masking(spark):
    rows = [(1, "a token=abcdefgh z", 18, "k"), (2, None, 0, None), (3, "clean", 5, "k"), (4, "é token=" + "0" * 40 + "!", 49, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, rules string")
    got = {r["doc_id"]: tuple(r) for r in s.without_secrets(docs).collect()}
    assert got == {
        1: (1, "a [SECRET] z", 12, "k"), 2: rows[1], 3: rows[2], 4: (4, "é [SECRET]!", 11, "k"),
    }


def test_rare_trigrams_stand_for_a_string():
    for rule in s.RULES:
        for strings in s.clauses(rule.pattern):
            asked = s.asked_trigrams(strings)
            # whatever holds a string of the clause holds all trigrams of one entry
            assert all(any(all(g in string for g in grams) for grams in asked) for string in strings)
            assert all(1 <= len(grams) <= s.KEPT for grams in asked)


def test_random_strings(spark):
    """Full scans of every rule against what the index lets through."""
    rng = random.Random(9)
    parts = ["token", "Secret", "api_key", "apikey", "PASSWORD", "passwd", "=", ":", " ", '"', "'", "abcdefgh", "x1", "AKIA", "ABCD1234EFGH", "0" * 31, "f" * 33, "g", "ghp_", "Z" * 36, "xoxb-", "0123456789", "AIza", "_" * 35, "sk_live_", "eyJ", ".", "-----BEGIN ", "PRIVATE KEY-----", "://u:pass@", "é𝄞"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = s.secret_report(docs).collect()
    check(rows, got)
    more = {r.kind: re.compile(r.pattern) for r in s.MORE_RULES}
    texts = dict(rows)
    for r in got:
        found = {x for x in r["spans"].split(",") if x and x.split(":")[0] in more}
        assert found == {f"{k}:{m.start()}:{m.end()}" for k, p in more.items() for m in p.finditer(texts[r["doc_id"]])}


def test_many_matches_in_one_text(spark):
    """Work that grows with the number of matches, not with its square."""
    rows = [
        (1, " ".join(f"token=abcdefgh{i}" for i in range(100_000))),
        (2, "0a1 " * 50_000 + "token: " + "f" * 40),
        (3, ("AKIA" + "B" * 12 + " ") * 30_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    started = time.perf_counter()
    check(rows, s.secret_report(docs).collect())
    clean = {r["doc_id"]: r["text"] for r in s.without_secrets(docs).collect()}
    assert time.perf_counter() - started < 60
    assert clean[1] == " ".join(["[SECRET]"] * 100_000) and clean[3] == "[SECRET] " * 30_000
    # the secret in hexadecimal digits lies within the assigned one
    assert clean[2] == "0a1 " * 50_000 + "[SECRET]"


def test_masks_over_long_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = [rng.choice(["é", "𝄞x", "plain", "token=abcdefgh", "f" * 40, "\n", "password:" + "1" * 40, "x" * 3000]) for _ in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(words)))

    def hidden(text):
        out, done = [], 0
        for start, _, end, _ in plain(text):
            if start >= done:
                out += [text[done:start], "[SECRET]"]
            done = max(done, end)
        return "".join(out) + text[done:]

    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in s.without_secrets(docs).collect()} == {i: hidden(t) for i, t in rows}


def test_a_column_of_the_same_name_is_kept(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh z", "mine", 7)], "doc_id bigint, text string, secret_spans string, kind int")
    assert tuple(s.without_secrets(docs).first()) == (1, "a [SECRET] z", "mine", 7)
    assert s.without_secrets(docs.limit(0)).collect() == []
