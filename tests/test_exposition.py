"""The metrics export's shared steps: tallies, replayed calls by name, admission over shared keys."""

import datetime as dt
import random

from pyspark.sql import functions as F

from missive.operators import breaker as B
from missive.operators import exposition as E

T0 = dt.datetime(2024, 1, 1)
BOUNDS = [0.1, 0.5, 2.0]


def test_tallied_samples_are_those_of_the_facts(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["sms", "email", None]), rnd.choice(["a", "b"]), None if i % 50 == 0 else rnd.choice([0.1, 0.3, 0.5, 1.5, 9.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "channel string, kind string, latency double")
    count = E.facts(df, "calls_total", ["kind"])
    plain = E.expose([count, E.facts(df, "lat", ["channel"], "latency", BOUNDS), E.facts(df, "all", [], "latency", BOUNDS[:2])], 3)
    more = [E.tallied(df, "lat", ["channel"], "latency", BOUNDS, 3), E.tallied(df, "all", [], "latency", BOUNDS[:2], 3)]
    got = sorted(map(tuple, E.expose([count], 3, more=more).collect()))
    assert got == sorted(map(tuple, plain.collect()))
    assert ("lat_bucket", 'channel="sms",le="0.5"', float(sum(r[0] == "sms" and (r[2] or 9) <= 0.5 for r in rows))) in got
    none = df.where("false")
    assert E.expose([E.facts(none, "c", [])], 3, more=[E.tallied(none, "all", [], "latency", BOUNDS, 3)]).count() == 0


def test_facts_are_hashed_not_sorted(spark):
    df = spark.range(10).select(F.lit("x").alias("channel"), F.col("id").cast("double").alias("latency"))
    plan = E.expose([E.facts(df, "lat", ["channel"], "latency", BOUNDS)], 3)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_whole_replay_steps_only_where_the_state_may_change(spark):
    """Verdicts of calls passed over are those of a call-by-call replay, and few calls are stepped through."""
    from missive.operators.fold import stream_fold
    df = spark.createDataFrame([(k, i, i % 10 == 0) for k in range(3) for i in range(200)], "k long, i long, mark boolean")
    steps = spark.sparkContext.accumulator(0)

    def step(s, i, mark):
        steps.add(1)
        s[0] += 1
        return s[0], True

    def skip(s, columns, i, end):
        j = i
        while j < end and not columns[1][j]:
            j += 1
        return j, (s[0], False)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = stream_fold(df, ["k"], ["i"], ["i", "mark"], lambda: [0], step, [("n", "long"), ("stepped", "boolean")], skip=skip).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got)) == [(k, i, i % 10 == 0, i // 10 + 1, i % 10 == 0) for k in range(3) for i in range(200)]
    assert steps.value == 60


def replay(rows, max_failures, window, open_s):
    """Verdicts in the order of (time, id), one breaker."""
    state = half = probe = until = None
    fails, out = 0, {}
    for i, t, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        if state is not None and t < state:
            v = "open"
        elif half is not None and t < half:
            v = "open" if probe is not None and t < probe else "probe"
            probe = t + 10 if v == "probe" else probe
        else:
            v = "closed"
        trip = False
        if v != "open" and ok:
            state = half = probe = until = None
            fails = 0
        elif v == "probe":
            state, half, probe, trip = t + open_s, t + open_s + 5, None, True
        elif v == "closed":
            fails, until = (fails + 1, until) if until is not None and t < until else (1, t + window)
            if fails >= max_failures:
                state, half, fails, until, trip = t + open_s, t + open_s + 5, 0, None, True
        out[i] = (v, v != "open", trip)
    return out


def test_whole_replay_of_a_breaker(spark):
    rnd = random.Random(5)
    rows, t = [], 0
    for i in range(3000):
        t += rnd.choice([0, 0, 0, 1, 1, 7]) if i % 500 else 90
        rows.append((i, t, None if i % 97 == 0 else rnd.random() > (0.6 if (i // 150) % 2 else 0.02)))
    df = spark.createDataFrame([(i, "w", T0 + dt.timedelta(seconds=t), ok) for i, t, ok in rows], "call_id long, name string, ts timestamp_ntz, ok boolean")
    got = {r["call_id"]: (r["verdict"], r["executed"], r["tripped"]) for r in B.breaker_replay(df, max_failures=5, window_s=10, open_s=30).collect()}
    assert got == replay(rows, 5, 10, 30) and {v[0] for v in got.values()} == {"open", "closed", "probe"}


def test_named_calls_keep_every_call_once_replayed(spark, tmp_path):
    """Calls without a notification are replayed (and may trip) but not known; several
    notifications of one id count a call several times, as a join does."""
    from missive.plans import dispatch
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    orders = [(1, 1), (2, 2), (2, 2), (None, 3)]
    spark.createDataFrame([(k, c, "O", 1.0, T0, "5-LOW") for k, c in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(k, n, T0 + dt.timedelta(seconds=n)) for k in (1, 2, 9, None) for n in range(1, 5)]
    spark.createDataFrame([(k, 1, 1, n, 10.0 * n, 1.0, 0.0, 0.0, "N", "F", t) for k, n, t in lines], "l_orderkey long, l_partkey long, l_suppkey long, "
                          "l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                          "l_linestatus string, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = dispatch.named_calls(spark, str(tmp_path)).collect()
    assert len(got) == 4 * 3 + 2 * 4 - 4 + 4 and sum(r["known"] for r in got) == 4 + 8
    assert sum(r["tripped"] for r in got) >= 1                     # all sixteen calls fail within four seconds
    counted = {(r["channel"], r["result"]): r["value"] for r in dispatch.webhook_calls(spark, str(tmp_path)).collect()}
    assert sum(counted.values()) == 12 and {k[1] for k in counted} == {"error", "circuit_open"}


def test_admission_rounds_hold_shared_keys_alone(spark, monkeypatch):
    """Calls that share no key are settled before the rounds."""
    from missive.operators import admission as A
    rows = [(b, f"own-{b}", b) for b in range(200)] + [(1, "x", 1), (5, "x", 5), (5, "y", 5), (9, "y", 9), (7, "z", 7), (7, "z", 7), (8, "z", 8)]
    df = spark.createDataFrame(rows, "batch_no long, key string, batch_order long")
    sizes, real = [], A.checkpoint_once
    monkeypatch.setattr(A, "checkpoint_once", lambda d: sizes.append(d.count()) or real(d))
    got = {r["batch_no"]: (r["admitted"], r["round"]) for r in A.batch_atomic_admission(df).collect()}
    assert len(got) == 200 and {b for b, v in got.items() if not v[0]} == {5, 7}
    assert got[7] == (False, 0) and got[8] == (True, 1) and got[1] == (True, 1) and got[5] == (False, 2) and got[9] == (True, 3)
    assert max(sizes) == 3                                          # 1, 5 and 9


def test_payloads_are_parsed_before_they_are_filtered(spark, tmp_path):
    """The relay and the consumer read the parse, and no payload: a filter on it would run in the scan's few tasks."""
    from missive.plans import metrics, windows
    rows = [(k, k % 7, "O", 1.0, T0 + dt.timedelta(hours=k), "1-URGENT" if k % 2 else "5-LOW") for k in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                          "o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    parsed = metrics.parsed_outbox(spark, str(tmp_path))
    assert parsed.count() == 400 and "payload" not in parsed.columns
    topics = metrics.consumed_by_topic(spark, str(tmp_path), parsed)
    assert "json" not in topics._jdf.queryExecution().executedPlan().toString().lower()
    got = {r["topic"]: r["value"] for r in topics.collect()}
    assert sum(got.values()) == parsed.where("NOT poison").count() < 400 and got["notifications-high"] > got["notifications-normal"]
    alone, shared = windows.relayed_total(spark, str(tmp_path)).collect(), windows.relayed_total(spark, str(tmp_path), parsed).collect()
    assert alone == shared
