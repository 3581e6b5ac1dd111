"""Strict JSON decoding, dates and cursors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from missive.functions import timefmt as TF
from missive.operators import ingest

GOOD = '{"idempotency_key":"k","recipient":"r","channel":"sms","content":"c","priority":"high"}'


def test_strict_single(spark):
    bodies = [GOOD, '{"idempotency_key":"k","extra":1}', "{broken", "", '{"priority":5}',
              '{"Channel":"sms"}', '{"priority":null}', "[1]"]
    df = spark.createDataFrame(list(enumerate(bodies)), "seq long, body string")
    r = {x["seq"]: x for x in ingest.parse_requests(df, "body").collect()}
    assert r[0]["error"] is None and r[0]["priority"] == "high"
    assert [r[i]["error"] for i in range(1, 8)] == ["unknown_field", "malformed_json", "empty_body",
                                                    "wrong_type", None, None, "not_an_object"]
    assert r[5]["channel"] == "sms"                        # keys match case-insensitively
    assert r[6]["priority"] == ""


def test_repeated_keys_and_body_size(spark):
    """The last value in the order of the text wins whatever the case of its key, null
    leaves what was there, every occurrence is type-checked, and size caps come first."""
    bodies = ['{"channel":"a","Channel":"b"}', '{"Channel":"a","channel":"b"}', '{"channel":"a","channel":"b"}',
              '{"channel":"a","channel":null}', '{"channel":5,"channel":"b"}', '{"content":"' + "x" * (512 * 1024) + '"}',
              '{"content":"' + "x" * (512 * 1024 - 14) + '"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "seq long, body string")
    r = {x["seq"]: x for x in ingest.parse_requests(df, "body").collect()}
    assert [r[i]["channel"] for i in range(4)] == ["b", "b", "b", "a"]
    assert [r[i]["error"] for i in range(7)] == [None] * 4 + ["wrong_type", "body_too_large", None]
    item = '{"channel":"a","CHANNEL":"b","channel":"c"}'
    batches = [(1, f"[{item},null]"), (2, '["x"]'), (3, '[{"content":"' + "x" * (1 << 20) + '"}]'), (4, "[")]
    rows, rej = ingest.parse_batches(spark.createDataFrame(batches, "batch_no long, body string"), "body", "batch_no")
    assert sorted((x["row_no"], x["channel"]) for x in rows.collect()) == [(1, "c"), (2, "")]
    assert dict((x["batch_no"], x["error"]) for x in rej.collect()) == {2: "bad_item", 3: "body_too_large", 4: "malformed_json"}


def test_payload_is_one_value(spark):
    from missive.operators.joins import poison_payload
    bodies = [('{"id":"1"}', False), ('{"id":"1"} junk', True), ('{"id":"1"},{"id":"2"}', True), ('{"id":"1"}] x', True), (' {"id":"]"} ', False),
              ("null", False), ("", True), ('{"id":"1"}} x', True), ('{"id":5}', True), ('{"channel":[]}', True)]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "i int, payload string")
    got = {r["i"]: r["p"] for r in df.select("i", poison_payload(F.col("payload")).alias("p")).collect()}
    assert [got[i] for i in range(len(bodies))] == [p for _, p in bodies]


def test_parsed_payload_is_the_poison_rule(spark):
    """The frame's parse agrees with the filter's rule, and each text is parsed once in an array."""
    from missive.operators.joins import parse_payload, poison_payload
    bodies = ['{"id":"1","channel":"sms"}', '{"id":"1"} junk', '{"id":"1"},null', '{"id":"1"}] x', ' {"id":"]","channel":"\\u0061"} ', "null", "null,null",
              "", " ", "[]", '[{"id":"1"}]', '"id"', "5", '{"id":5,"channel":"x"}', '{"id":"1","other":[1]}', '{"channel":[]}', "{}", '{"id":null}',
              '{"id":"1","id":"2"}', '{"id":"1","recipient":{"id":"3"}}', "not json", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, payload string")
    parsed = parse_payload(df, "payload", {"nid": "id", "channel": "channel"})
    got = {r["i"]: r for r in parsed.collect()}
    want = {r["i"]: r["p"] for r in df.select("i", poison_payload(F.col("payload")).alias("p")).collect()}
    assert {i: r["poison"] for i, r in got.items()} == want and sum(want.values()) == 16
    assert [(got[i]["nid"], got[i]["channel"]) for i in (0, 1, 2, 4, 5, 13, 14, 17)] == [
        ("1", "sms"), ("", ""), ("", ""), ("]", "a"), ("", ""), ("5", "x"), ("1", ""), ("", "")]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat([, ") == 1, plan


def test_batches(spark):
    big = "[" + ",".join([GOOD] * 1001) + "]"
    bodies = [(1, "[" + GOOD + "," + GOOD.replace('"k"', '"k2"') + "]"), (2, "[]"), (3, big),
              (4, "[" + GOOD + ',{"x":1}]'), (5, "{}")]
    df = spark.createDataFrame(bodies, "batch_no long, body string")
    rows, rej = ingest.parse_batches(df, "body", "batch_no")
    assert sorted((r["batch_no"], r["row_no"], r["idempotency_key"]) for r in rows.collect()) == \
           [(1, 1, "k"), (1, 2, "k2")]
    assert dict((r["batch_no"], r["error"]) for r in rej.collect()) == {
        2: "empty_batch", 3: "batch_too_large", 4: "bad_item", 5: "not_an_array"}


def test_date_params():
    assert TF.parse_date_param("2026-03-27T10:00:00Z") == (dt.datetime(2026, 3, 27, 10), True)
    assert TF.parse_date_param("2026-03-27T15:30:00+03:00") == (dt.datetime(2026, 3, 27, 12, 30), True)
    assert TF.parse_date_param("2026-03-27", end_of_day=True) == (dt.datetime(2026, 3, 28), False)
    for bad in ("not-a-date", "", "2026-03", "10:00:00"):
        with pytest.raises(ValueError):
            TF.parse_date_param(bad)
    with pytest.raises(ValueError):
        TF.check_date_range("2026-04-01", "2026-03-01")


def test_cursor_roundtrip(spark):
    c = TF.encode_cursor_py(dt.datetime(2026, 3, 27, 10, 0, 0, 123400), "550e8400-e29b-41d4-a716-446655440000")
    t, i = TF.decode_cursor_py(c)
    assert t == dt.datetime(2026, 3, 27, 10, 0, 0, 123400) and i.startswith("550e")
    for bad in ("invalid-base64!!!", "bm8tcGlwZQ=="):
        with pytest.raises(ValueError):
            TF.decode_cursor_py(bad)
    df = spark.createDataFrame([(c,), ("invalid-base64!!!",)], "c string")
    got = df.select(TF.decode_cursor(F.col("c")).alias("d")).select("d.*").collect()
    assert got[0]["ok"] and got[0]["cursor_time"] == dt.datetime(2026, 3, 27, 10, 0, 0, 123400)
    assert not got[1]["ok"]
    sp = spark.createDataFrame([(dt.datetime(2026, 3, 27, 10, 0, 0, 500000),)], "t timestamp_ntz")
    assert sp.select(TF.rfc3339_nano(F.col("t"))).first()[0] == "2026-03-27T10:00:00.5Z"
