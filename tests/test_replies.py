from __future__ import annotations

import datetime as dt
import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators.normalize import normalize
from ledger_spark.schema import REPLIES
from ledger_spark.sources.replies import (
    close_truncated,
    decode_advice,
    read_replies,
    read_written,
    rejected_replies,
    reply_transactions,
    write_replies,
)
from ledger_spark.streaming.intake import reply_stream, start_intake

RECORDS = [
    {"date": "2024-01-05", "description": "a }, b", "amount": -5, "type": "debit", "category": "Food"},
    {"date": "2024-01-06", "description": 'say "hi"', "amount": "7.25", "type": None, "category": None},
    {"date": "bad", "description": "c", "amount": "x", "type": "credit", "category": "Fees"},
]


def envelope(content, reason="stop"):
    return json.dumps({"choices": [{"message": {"content": content}, "finish_reason": reason}]})


def read(spark, *responses):
    rows = [(f"s{i}", i, r) for i, r in enumerate(responses)]
    return read_replies(spark.createDataFrame(rows, REPLIES))


def statuses(df):
    return [(r.status, None if r.records is None else len(r.records)) for r in df.orderBy("statement_id").collect()]


def test_shapes(spark):
    whole = json.dumps({"transactions": RECORDS})
    df = read(
        spark,
        envelope(whole),
        envelope(json.dumps(RECORDS)),
        envelope("{}"),
        envelope(json.dumps({"transactions": None})),
        envelope(json.dumps({"other": 1})),
        envelope("sorry, no"),
        envelope(whole + " trailing words"),
        envelope("5"),
        "not an envelope",
    )
    assert statuses(df) == [
        ("parsed", 3),
        ("parsed", 3),
        ("parsed", 0),
        ("parsed", 0),
        ("parsed", 0),
        ("rejected", None),
        ("rejected", None),
        ("rejected", None),
        ("rejected", None),
    ]


def test_missing_content_is_an_empty_object(spark):
    df = read(spark, json.dumps({"choices": [{"finish_reason": "stop"}]}), "{}")
    assert statuses(df) == [("parsed", 0), ("parsed", 0)]


def test_values_are_converted_and_numbered(spark):
    rows = reply_transactions(read(spark, envelope(json.dumps({"transactions": RECORDS})))).orderBy("seq").collect()
    assert [(r.seq, r.date, r.amount, r.type, r.category) for r in rows] == [
        (0, dt.datetime(2024, 1, 5), Decimal("-5.00"), "debit", "Food"),
        (1, dt.datetime(2024, 1, 6), Decimal("7.25"), None, None),
        (2, None, None, "credit", "Fees"),
    ]
    assert [r.description for r in rows] == ["a }, b", 'say "hi"', "c"]


def test_field_names_are_lower_cased_first(spark):
    content = '[{"Date": "2024-01-05", "AMOUNT": "3", "amount": 4, "Branch": {"a": 1}, "branch": "x", "note": "n"}]'
    only = reply_transactions(read(spark, envelope(content))).first()
    assert (only.date, only.amount) == (dt.datetime(2024, 1, 5), Decimal("4.00"))
    assert only.extras == {"branch": "x", "note": "n"}


@pytest.mark.parametrize("name", ["amount", "Amount"])
def test_last_of_exact_duplicate_keys_counts(spark, name):
    content = f'[{{"{name}": 1, "x": 0, "{name}": 2, "x": 9}}]'
    only = reply_transactions(read(spark, envelope(content))).first()
    assert only.amount == Decimal("2.00") and only.extras == {"x": "9"}


def python_repair(text):
    """The repair rule on one string; None when it cannot apply."""
    cut = text.rfind("},")
    if cut < 0:
        cut = text.rfind("}")
    if cut < 0:
        return None
    return text[: cut + 1] + ("]\n}" if "transactions" in text else "]")


@pytest.mark.parametrize("whole", [json.dumps({"transactions": RECORDS}), json.dumps(RECORDS)])
def test_every_prefix_is_repaired_like_the_rule(spark, whole):
    prefixes = [whole[:n] for n in range(len(whole) + 1)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prefixes)], "i int, text string")
    got = [r[0] for r in df.select("i", close_truncated(F.col("text")).alias("t")).orderBy("i").select("t").collect()]
    assert got == [python_repair(p) for p in prefixes]

    outcome = read(spark, *[envelope(p, "length") for p in prefixes]).collect()
    by_number = {int(r.statement_id[1:]): r for r in outcome}
    for i, prefix in enumerate(prefixes):
        try:
            expected = json.loads(prefix)
        except ValueError:
            try:
                expected = json.loads(python_repair(prefix))
            except (ValueError, TypeError):
                expected = None
        if isinstance(expected, dict):
            expected = expected.get("transactions", [])
        found = by_number[i].records
        assert (None if found is None else len(found)) == (None if expected is None else len(expected)), prefix


def test_truncated_but_stopped_is_rejected(spark):
    cut = json.dumps({"transactions": RECORDS})[:-30]
    df = read(spark, envelope(cut, "stop"), envelope(cut, "length"), envelope(cut, None))
    assert statuses(df) == [("rejected", None), ("repaired", 2), ("rejected", None)]
    assert rejected_replies(df).count() == 2


def test_rejects_keep_their_raw_text(spark):
    df = read(spark, "junk", envelope("[]"), None)
    assert sorted(map(tuple, rejected_replies(df).collect()), key=repr) == [("s0", 0, "junk"), ("s2", 2, None)]


def parses(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"(?i)(?<!try_)parse_?json", plan)), len(re.findall(r"(?i)from_?json|get_?json_?object", plan))


def test_each_text_is_parsed_once(spark):
    """The reply, its content, and the content as mended if it was cut off."""
    df = read(spark, envelope("[]"))
    for table in (df, reply_transactions(df), rejected_replies(df)):
        assert parses(table) == (3, 0)


def test_both_sinks_in_one_pass(spark, tmp_path):
    whole = json.dumps({"transactions": RECORDS})
    replies_ = [envelope(whole), "junk", envelope("{}"), envelope(whole[:-30], "length"), envelope(whole[:-30]), None]
    df = read(spark, *replies_)
    write_replies(df, str(tmp_path / "out"))
    accepted, rejected = read_written(spark, str(tmp_path / "out"))
    expected = reply_transactions(df)
    assert accepted.columns == expected.columns
    text = [c for c in expected.columns if c != "extras"]
    assert sorted(map(tuple, accepted.select(text).collect()), key=repr) == sorted(map(tuple, expected.select(text).collect()), key=repr)
    assert {r.response for r in rejected.collect()} == {"junk", replies_[4], None} and rejected.count() == 3


def test_elements_that_are_no_objects(spark):
    df = read(spark, envelope("[5]"), envelope('{"transactions": [{"a": 1}, "x"]}'), envelope('[{"a": 1}, null]'), envelope('{"transactions": {"a": 1}}'))
    assert statuses(df) == [("rejected", None), ("rejected", None), ("parsed", 2), ("parsed", 0)]


def test_decode_advice(spark):
    contents = [
        '{"summary": "s", "tips": ["a", "b"], "custom_advice": "c"}',
        '{"summary": "s"}',
        "{}",
        "junk",
        None,
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, c string")
    got = [r.a for r in df.select("i", decode_advice(F.col("c")).alias("a")).orderBy("i").collect()]
    assert tuple(got[0]) == ("s", ["a", "b"], "c")
    assert tuple(got[1]) == ("s", [], "") and tuple(got[2]) == ("", [], "")
    assert got[3] is None and got[4] is None


def test_stream_of_replies(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def deliver(name, statement, content):
        line = json.dumps({"statement_id": statement, "account_id": 1, "response": envelope(content)})
        (inbox / name).write_text(line + "\n")

    def run():
        start_intake(reply_stream(spark, str(inbox)), out, checkpoint).awaitTermination()

    deliver("one.json", "s1", json.dumps(RECORDS))
    run()
    deliver("two.json", "s2", "junk")
    deliver("three.json", "s3", json.dumps({"transactions": RECORDS[:1]}))
    run()
    run()  # nothing new
    accepted, rejected = read_written(spark, out)
    assert sorted((r.statement_id, r.seq) for r in accepted.collect()) == [("s1", 0), ("s1", 1), ("s1", 2), ("s3", 0)]
    assert [tuple(r) for r in rejected.collect()] == [("s2", 1, envelope("junk"))]
    batch = normalize(reply_transactions(read(spark, envelope(json.dumps(RECORDS)))))
    assert set(batch.columns) | {"batch"} == set(accepted.columns)


def test_numbers_too_large_for_an_amount_leave_a_trace(spark):
    content = json.dumps([{"date": "2024-01-05", "amount": "1" + "0" * 17}, {"date": "2024-01-05", "amount": "12"}, {"amount": "x"}])
    response = json.dumps({"choices": [{"message": {"content": content}}]})
    rows = reply_transactions(read_replies(spark.createDataFrame([("s", 1, response)], REPLIES))).orderBy("seq").collect()
    assert [r.amount for r in rows] == [None, 12, None]
    assert [r.extras.get("amount") for r in rows] == ["1" + "0" * 17, None, None]
