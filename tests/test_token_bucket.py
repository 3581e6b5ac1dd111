"""The two-tier token bucket against a direct replay, and what of it stays sequential."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from missive.operators import api_calls as AC
from missive.operators import limits as L
from missive.operators import token_bucket as TB
from missive.plans.api import API_CAPACITY, API_RATE, decoded


def replay(rows, capacity, rate):
    rate, out, state = Fraction(rate).limit_denominator(1_000_000), {}, {}
    for rid, key, us, w in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(key, (Fraction(capacity), us))
        tokens = min(Fraction(capacity), tokens + rate * Fraction(us - last, 1_000_000))
        ok = tokens >= w
        tokens -= w if ok else 0
        state[key] = (tokens, us)
        out[rid] = (ok, round(float(tokens), 6))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, key string, us long, w int")
    return df.withColumn("ts", F.timestamp_micros("us"))


def test_random_load_matches_replay(spark):
    rnd = random.Random(3)
    for load, capacity, rate in ((0.4, 10, 1.0), (1.0, 7, 0.5), (3.0, 10, 1 / 3)):
        rows, t = [], 0
        for i in range(700):
            t += int(rnd.expovariate(1) * 3e6 / load) if rnd.random() > 0.2 else 0
            rows.append((i, rnd.choice(["a", "b", None]), 1_700_000_000_000_000 + t, rnd.choice([0, 1, 1, 2, 5, 11])))
        got = L.limit_token_bucket(frame(spark, rows), "key", "ts", "id", "w", capacity, rate)
        got = {r["id"]: (r["allowed"], round(r["tokens_left"], 6)) for r in got.collect()}
        assert got == replay(rows, capacity, rate)
        assert {a for a, _ in got.values()} == {True, False}


def test_reference_cases(spark):
    for capacity, rate, weights, want in ((10, 1, [5, 6], [True, False]), (10, 1, [10, 1], [True, False]), (10, 1, [0], [True])):
        rows = [(i, "k", 1_000_000 + i, w) for i, w in enumerate(weights)]
        got = L.limit_token_bucket(frame(spark, rows), "key", "ts", "id", "w", capacity, rate).orderBy("id").collect()
        assert [r["allowed"] for r in got] == want


def test_empty(spark):
    assert L.limit_token_bucket(frame(spark, []), "key", "ts", "id", "w", 10, 1).count() == 0


def test_few_api_calls_stay_open(spark):
    """Only the rows after a client's demand first exceeds its bucket are folded."""
    api = decoded(spark, "/root/testdata/sf0.1")
    calls = api.calls
    _unit, _p, cap = TB.amounts(API_CAPACITY, API_RATE)
    balance = TB.all_admit_balance(calls, "key", "ts", "call_id", "weight", API_CAPACITY, API_RATE)
    sure, open_ = TB.split_tiers(balance, "key", "call_id", cap)
    n, n_open = calls.count(), open_.count()
    refused = AC.quota(calls, API_CAPACITY, API_RATE).where("NOT allowed").count()
    assert sure.count() + n_open == n and 0 < refused <= n_open < n / 5


def test_calls_refused_by_decoding_spend_nothing(spark):
    item = '{"idempotency_key":"%s","recipient":"a@b.c","channel":"email","content":"x","priority":"low"}'
    singles = spark.createDataFrame([(1, item % "k1"), (2, '{"bad":1}'), (3, (item % "k3").replace("email", "fax")), (4, "")], "seq long, body string")
    batches = spark.createDataFrame([(1, "[%s,%s]" % (item % "b1", item % "b2")), (2, '[{"bad":1}]'), (3, "[]"),
                                     (4, "[%s]" % (item % "b4").replace("email", "fax"))], "batch_no long, body string")
    at = F.timestamp_micros(F.lit(1_000_000)).cast("timestamp_ntz")
    api = AC.decode_calls(singles.withColumn("arrival_ts", at), batches.withColumn("arrival_ts", at), F.lit("1.2.3.4"))
    assert {(r["call_id"], r["weight"]) for r in api.calls.collect()} == {("s-1", 1), ("b-1", 2), ("b-4", 1)}
    verdicts = AC.quota(api.calls, 3, 1)
    none = spark.createDataFrame([("k1",)], "idempotency_key string")
    done = AC.committed(api, verdicts, none)
    assert [r["call_id"] for r in done.collect()] == ["b-1"]
