"""Validation cases taken from the reference's tests (as literal rows)."""

import pytest
from pyspark.sql import functions as F

from missive.operators import validate as V
from missive.operators.projections import client_ip, limit_clamp, uuid_canonical

COLS = "seq long, idempotency_key string, recipient string, channel string, content string, priority string"


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return {r["seq"]: r for r in V.validate_requests(df).collect()}


def test_phone_cases(spark):
    ok = ["+905551234567", "905551234567", "+12345678", "+123456789012345"]
    bad = ["+123", "test@example.com", "+", "+1234567890123456", "+90555abc4567", "+90555-123-4567",
           "+9055512345\n67"]
    rows = [(i, f"k{i}", r, "sms", "hi", "") for i, r in enumerate(ok + bad)]
    v = verdicts(spark, rows)
    for i in range(len(ok)):
        assert v[i]["error"] is None
    for i in range(len(ok), len(ok) + len(bad)):
        assert v[i]["error"] == "sms_phone_format", rows[i]


def test_channels_and_priorities(spark):
    rows = [(0, "k", "+905551234567", "sms", "x", ""), (1, "k", "a@b", "EMAIL", "x", ""),
            (2, "k", "d", "Push", "x", "low"), (3, "k", "d", "telegram", "x", ""),
            (4, "k", "d", "", "x", ""), (5, "k", "d", "push", "x", "urgent"),
            (6, "k", "d", "push", "x", "  HIGH  "), (7, "k", "not-an-email", "email", "x", "")]
    v = verdicts(spark, rows)
    assert [v[i]["error"] for i in range(8)] == [None, None, None, "invalid_channel", "invalid_channel",
                                                 "invalid_priority", None, "email_address_format"]
    assert v[0]["priority"] == "normal" and v[6]["priority"] == "high"


@pytest.mark.parametrize("channel,limit,code", [("sms", 160, "sms_too_long"), ("push", 512, "push_too_long"),
                                                ("email", 2048, "content_too_large")])
def test_byte_limits(spark, channel, limit, code):
    rcp = {"sms": "+905551234567", "email": "a@b", "push": "d"}[channel]
    rows = [(0, "k", rcp, channel, "x" * limit, ""), (1, "k", rcp, channel, "x" * (limit + 1), "")]
    v = verdicts(spark, rows)
    assert v[0]["error"] is None and v[1]["error"] == code


def test_multibyte_counts_bytes(spark):
    v = verdicts(spark, [(0, "k", "+905551234567", "sms", "é" * 81, "")])   # 162 bytes, 81 chars
    assert v[0]["error"] == "sms_too_long"


def test_key_rules_and_order(spark):
    rows = [(0, "k" * 255, "d", "push", "x", ""), (1, "k" * 256, "d", "push", "x", ""),
            (2, "   ", "d", "push", "x", ""), (3, "k", "", "push", "", ""),
            (4, "k", "+905551234567", "sms", "x" * 2049, "")]
    v = verdicts(spark, rows)
    assert v[0]["error"] is None
    assert v[1]["error"] == "key_too_long"
    assert v[2]["error"] == "key_required"
    assert v[3]["error"] == "recipient_required"
    assert v[4]["error"] == "content_too_large"          # general size error before the sms one


def test_normalization_unicode_space(spark):
    rows = [(0, " k ", " +905551234567 ", "  SMS  ", "  test content  ", "  HIGH  ")]
    r = verdicts(spark, rows)[0]
    assert (r["channel"], r["priority"], r["recipient"], r["content"], r["idempotency_key"]) == \
           ("sms", "high", "+905551234567", "test content", "k")


def test_batch_first_invalid_row_number(spark):
    rows = [(0, "a", "d", "push", "x", ""), (1, "b", "", "push", "x", ""), (2, "c", "d", "fax", "x", "")]
    df = spark.createDataFrame(rows, COLS).withColumn("batch_no", F.lit(7))
    r = V.batch_first_invalid(df).collect()
    assert [(x["batch_no"], x["row_no"], x["error"]) for x in r] == [(7, 2, "recipient_required")]


def test_client_ip(spark):
    df = spark.createDataFrame([("", "192.168.1.1:12345"), ("10.0.0.1, 10.0.0.2, 10.0.0.3", "1.2.3.4:5"),
                                ("", "10.1.1.1"), ("", "[::1]:80")], "xff string, remote string")
    got = [r[0] for r in df.select(client_ip(F.col("xff"), F.col("remote"))).collect()]
    assert got == ["192.168.1.1", "10.0.0.1", "", "::1"]


def test_uuid_and_limit(spark):
    u = "550e8400-e29b-41d4-a716-446655440000"
    df = spark.createDataFrame([(u,), (u.upper(),), ("urn:uuid:" + u,), ("{" + u + "}",),
                                (u.replace("-", ""),), ("not-a-uuid",)], "x string")
    got = [r[0] for r in df.select(uuid_canonical(F.col("x"))).collect()]
    assert got == [u] * 5 + [None]
    lim = spark.createDataFrame([("5",), ("0",), ("101",), ("abc",), ("100",), ("",)], "x string")
    assert [r[0] for r in lim.select(limit_clamp(F.col("x"))).collect()] == [5, 10, 10, 10, 100, 10]
