"""Limiters, breaker, offsets and lifecycle: reference cases plus random logs checked
against a direct replay of the rules (written here, row by row)."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from missive.operators import breaker as B
from missive.operators import limits as L
from missive.operators import offsets as O

T0 = dt.datetime(2024, 1, 1)


def ts(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def req_df(spark, rows):
    return spark.createDataFrame([(i, k, ts(ms), w) for i, k, ms, w in rows],
                                 "req_id long, key string, ts timestamp_ntz, weight int")


def replay_sliding(rows, limit, window):
    logs, out = collections.defaultdict(collections.deque), {}
    for i, k, ms, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        log = logs[k]
        while log and log[0] <= ms - window:
            log.popleft()
        out[i] = len(log) < limit
        if out[i]:
            log.append(ms)
    return out


def replay_bucket(rows, cap, rate):
    st, out = {}, {}
    for i, k, ms, w in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        now = float(ms // 1000) + float(ms % 1000 * 1000) / 1000000
        if k not in st:
            tok, last = float(cap), now
        else:
            tok, last = st[k]
            tok, last = min(float(cap), tok + max(0.0, now - last) * rate), now
        out[i] = tok >= w
        st[k] = (tok - w if out[i] else tok, last)
    return out


def test_sliding_reference_cases(spark):
    rows = [(i, "a", 10 * i, 1) for i in range(6)] + [(10, "b", 0, 1), (11, "b", 5, 1)]
    got = {r["req_id"]: r["allowed"] for r in L.limit_sliding(req_df(spark, rows), "key", "ts", "req_id", 5, 1000)
           .collect()}
    assert [got[i] for i in range(6)] == [True] * 5 + [False]
    got1 = {r["req_id"]: r["allowed"] for r in L.limit_sliding(req_df(spark, rows), "key", "ts", "req_id", 1, 1000)
            .collect()}
    assert got1[10] and not got1[11]


def test_token_bucket_reference_cases(spark):
    rows = [(0, "a", 0, 5), (1, "a", 1, 6), (2, "b", 0, 10), (3, "b", 1, 1), (4, "c", 0, 0)]
    got = {r["req_id"]: r["allowed"] for r in
           L.limit_token_bucket(req_df(spark, rows), "key", "ts", "req_id", "weight", 10, 1).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_fixed_window(spark):
    rows = [(i, "a", 100 * i, 1) for i in range(4)]
    got = {r["req_id"]: r["allowed"] for r in L.limit_fixed(req_df(spark, rows), "key", "ts", "req_id", 3).collect()}
    assert [got[i] for i in range(4)] == [True, True, True, False]


def test_random_limiters_match_replay(spark):
    rnd = random.Random(7)
    rows, t = [], 0
    for i in range(3000):
        t += rnd.choice([0, 1, 5, 50, 300, 900, 4000])
        rows.append((i, rnd.choice("abc"), t, rnd.randint(0, 4)))
    df = req_df(spark, rows)
    got = {r["req_id"]: r["allowed"] for r in L.limit_sliding(df, "key", "ts", "req_id", 4, 1000).collect()}
    assert got == replay_sliding(rows, 4, 1000)
    got = {r["req_id"]: r["allowed"] for r in
           L.limit_token_bucket(df, "key", "ts", "req_id", "weight", 10, 2.5).collect()}
    assert got == replay_bucket(rows, 10, 2.5)


def replay_breaker(calls, mx, win, opn):
    """calls: (id, name, t_us, ok) -> verdicts, one state dict per name."""
    S, out = {}, {}
    for cid, name, t, ok in sorted(calls, key=lambda c: (c[1], c[2], c[0])):
        s = S.setdefault(name, dict(state=None, half=None, probe=None, fails=0, fu=None))
        alive = lambda k: s[k] is not None and t < s[k]
        trip = False
        if alive("state"):
            v = "open"
        elif alive("half"):
            v = "open" if alive("probe") else "probe"
            if v == "probe":
                s["probe"] = t + 10_000_000
        else:
            v = "closed"
        if v != "open":
            if ok:
                s.update(state=None, half=None, probe=None, fails=0, fu=None)
            elif v == "probe":
                s.update(state=t + opn * 10**6, half=t + (opn + 5) * 10**6, probe=None)
                trip = True
            else:
                if not alive("fu"):
                    s["fails"], s["fu"] = 1, t + win * 10**6
                else:
                    s["fails"] += 1
                if s["fails"] >= mx:
                    s.update(state=t + opn * 10**6, half=t + (opn + 5) * 10**6, fails=0, fu=None)
                    trip = True
        out[cid] = (v, trip)
    return out


def calls_df(spark, calls):
    return spark.createDataFrame([(c, n, T0 + dt.timedelta(microseconds=t), ok) for c, n, t, ok in calls],
                                 "call_id long, name string, ts timestamp_ntz, ok boolean")


def test_breaker_reference_cases(spark):
    s = 10**6
    calls = [(0, "a", 0, False), (1, "a", s, False), (2, "a", 2 * s, False), (3, "a", 3 * s, True),
             (10, "b", 0, False), (11, "b", s, False), (12, "b", 2 * s, True), (13, "b", 3 * s, False),
             (14, "b", 4 * s, True)]
    got = {r["call_id"]: (r["verdict"], r["tripped"]) for r in
           B.breaker_replay(calls_df(spark, calls), max_failures=3, window_s=10, open_s=30).collect()}
    assert got[2] == ("closed", True) and got[3] == ("open", False)
    assert all(got[i][0] == "closed" and not got[i][1] for i in (10, 11, 12, 13, 14))
    probe = [(0, "p", 0, False), (1, "p", int(1.5 * s), True), (2, "p", 3 * s, False),
             (3, "p", int(4.5 * s), False), (4, "p", int(4.6 * s), True)]
    got = {r["call_id"]: (r["verdict"], r["tripped"]) for r in
           B.breaker_replay(calls_df(spark, probe), max_failures=1, window_s=1, open_s=1).collect()}
    assert got[0] == ("closed", True) and got[1] == ("probe", False)
    assert got[2] == ("closed", True) and got[3] == ("probe", True) and got[4] == ("open", False)


def test_random_breaker_matches_replay(spark):
    rnd = random.Random(3)
    calls, t = [], 0
    for i in range(3000):
        t += rnd.choice([0, 200_000, 1_000_000, 3_000_000, 20_000_000, 60_000_000])
        calls.append((i, rnd.choice("xy"), t, rnd.random() < 0.5))
    got = {r["call_id"]: (r["verdict"], r["tripped"]) for r in
           B.breaker_replay(calls_df(spark, calls), max_failures=3, window_s=10, open_s=30).collect()}
    assert got == replay_breaker(calls, 3, 10, 30)


def test_concurrent_breaker_single_call_equals_replay(spark):
    rnd = random.Random(5)
    calls, t = [], 0
    for i in range(500):
        t += rnd.choice([1_000_000, 3_000_000, 20_000_000])
        calls.append((i, "z", t, rnd.random() < 0.4))
    df = calls_df(spark, calls).withColumn("end_ts", F.col("ts"))          # zero-length calls
    got = {r["call_id"]: (r["verdict"], r["tripped"]) for r in
           B.breaker_concurrent(df, max_failures=3, window_s=10, open_s=30).collect()}
    want = replay_breaker(calls, 3, 10, 30)
    assert got == want


def offsets_df(spark, rows):
    return spark.createDataFrame(rows, "topic string, partition int, offset long, done_rank long")


def test_commit_watermark_cases(spark):
    rows = [("t", 0, o, r) for o, r in [(0, None), (1, None), (2, 5)]]
    assert O.committed_offsets(O.commit_watermark(offsets_df(spark, rows))).count() == 0
    rows = [("t", 0, 0, 1), ("t", 0, 1, None), ("t", 0, 2, 2), ("t", 0, 3, 3), ("t", 0, 4, 4), ("t", 1, 0, 9)]
    got = {(r[0], r[1]): r[2] for r in O.committed_offsets(O.commit_watermark(offsets_df(spark, rows))).collect()}
    assert got == {("t", 0): 0, ("t", 1): 0}
    rows[1] = ("t", 0, 1, 7)
    got = {(r[0], r[1]): r[2] for r in O.committed_offsets(O.commit_watermark(offsets_df(spark, rows))).collect()}
    assert got[("t", 0)] == 4


def test_random_watermark_matches_replay(spark):
    rnd = random.Random(11)
    rows = [("t", p, o, None if rnd.random() < 0.01 else rnd.randint(0, 100000))
            for p in range(3) for o in range(9000)]
    got = {(r["partition"], r["offset"]): r["commit_rank"]
           for r in O.commit_watermark(offsets_df(spark, rows)).collect()}
    for p in range(3):
        run = -1
        for o in range(9000):
            d = rows[p * 9000 + o][3]
            run = float("inf") if d is None or run == float("inf") else max(run, d)
            assert got[(p, o)] == (None if run == float("inf") else run)


def test_sliding_fold_sees_only_contested_rows(spark):
    """Steady traffic under the limit needs no fold; around a burst only one window does."""
    from missive.operators import limits as L
    rows = [(i, "k", i * 100) for i in range(3000)] + [(10_000 + i, "k", 150_000 + i) for i in range(30)]
    d = spark.createDataFrame(rows, "req_id long, key string, _ms long")
    d = d.withColumn("_bk", L.bucket_of_window("_ms", 1000))

    def folded(x):
        runs = L.contested_buckets(x, "key", 12, 1000)
        return x.join(runs, (x["key"] == runs["_k"]) & (x["_bk"] == runs["_bk"]), "left_semi")

    near = {r["req_id"] for r in folded(d).collect()}
    assert {10_000 + i for i in range(30)} <= near
    assert all(149_000 <= ms < 152_000 for i, _, ms in rows if i in near) and len(near) < 70
    assert folded(d.where("req_id < 3000")).count() == 0


def test_contested_runs_across_stretches_match_replay(spark, monkeypatch):
    """Runs that cross the borders of window partitions, pauses of every length, keys that are null."""
    monkeypatch.setattr(L, "STRETCH", 2 * L.PARTS)
    rng = random.Random(5)
    rows, ms = [], 0
    for i in range(1500):
        ms += rng.choice([0, 1, 30, 125, 126, 400, 875, 999, 1000, 1001, 1125, 1300])
        rows.append((i, rng.choice(["a", "b", None]), ms, 1))
    got = {r["req_id"]: r["allowed"] for r in L.limit_sliding(req_df(spark, rows), "key", "ts", "req_id", 2, 1000).collect()}
    assert got == replay_sliding([(i, k or "", ms, w) for i, k, ms, w in rows], 2, 1000)
    assert not all(got.values())


def test_contested_buckets_make_no_row_per_empty_bucket(spark):
    """A lonely hot bucket is one row: the empty buckets around it are not written out."""
    d = spark.createDataFrame([("k", i * 100_000) for i in range(50) for _ in range(3)], "key string, _ms long")
    runs = L.contested_buckets(d.withColumn("_bk", L.bucket_of_window("_ms", 1000)), "key", 2, 1000).collect()
    assert len(runs) == 50 and len({r["_seg"] for r in runs}) == 50


def _split_events(spark):
    """Histories with locks that rest, refusals and late outcomes, and their final rows."""
    from missive.operators import lifecycle as LC
    sec = lambda x: T0 + dt.timedelta(seconds=x)
    made = spark.createDataFrame([(i, T0) for i in "abcde"], "id string, created_at timestamp_ntz")
    none = spark.createDataFrame([], "id string, attempt_ts timestamp_ntz, http_status int, message_id string, attempt_no int, latency_s double")
    locks = [("a", 10), ("a", 1200), ("b", 1), ("b", 5), ("b", 12), ("c", 1), ("e", 1), ("x", 1)] + [("d", 600 * k) for k in range(4)]
    outcomes = [("b", 13, 200, "m1"), ("c", 3, 400, None), ("e", 600, 200, "late")]
    at = "id string, ts timestamp_ntz"
    ev = LC.event_log(made, none, spark.createDataFrame([("c", sec(2)), ("d", sec(2400))], at),
                      locks=spark.createDataFrame([(i, sec(t)) for i, t in locks], at),
                      refusals=spark.createDataFrame([("b", sec(1))], at),
                      outcomes=spark.createDataFrame([(i, sec(t), h, m) for i, t, h, m in outcomes], at + ", http_status int, message_id string"))
    want = {"a": ("processing", 1, None, None, sec(1200), 4, 1, 0),            # stuck, swept, locked again
            "b": ("delivered", 0, sec(11), "m1", sec(13), 6, 0, 1),            # refused, swept after 10 s, delivered
            "c": ("failed_permanently", 1, None, None, sec(3), 3, 0, 0),       # no cancel while processing
            "d": ("failed_permanently", 3, None, None, sec(2100), 9, 4, 0),    # stuck four times
            "e": ("pending", 1, None, None, sec(301), 3, 1, 0)}                # an outcome after the sweep is void
    return ev, want


def test_lifecycle_locks_refusals_and_stuck_rows(spark):
    from missive.operators import lifecycle as LC
    ev, want = _split_events(spark)
    assert {r[0]: tuple(r)[1:] for r in LC.final_rows(LC.lifecycle_fold(ev)).collect()} == want


def test_lifecycle_stream_sweeps_a_resting_lock(spark, tmp_path):
    from missive.streaming import jobs as X
    ev, want = _split_events(spark)
    src = str(tmp_path / "events")
    ev.write.parquet(src)
    out = X.run_to_parquet(X.lifecycle_stream(spark.readStream.schema(ev.schema).parquet(src), "1 minute"), "t_lifecycle")
    got = {r["id"]: r for r in spark.read.parquet(out).orderBy("moves").collect()}
    sweep = {"a": ("pending", 2, 5)}                  # the watermark (last event less a minute) passes a's second lock + 5 min
    for i, w in want.items():
        assert (got[i]["status"], got[i]["retry_count"], got[i]["moves"]) == sweep.get(i, (w[0], w[1], w[5])), i


def test_concurrent_breaker_is_cut_where_it_is_idle(spark):
    """Three pieces where nothing is in flight for longer than every expiry; a call that
    spans a pause holds its piece together, and verdicts are those of the whole timeline."""
    rnd = random.Random(3)
    calls, t = [], 0
    for i in range(300):
        t += rnd.randint(200, 3000) if i not in (100, 200, 250) else 100_000
        calls.append((i, "z", t, rnd.random() < 0.4, t + rnd.randint(0, 4000)))
    calls[249] = calls[249][:4] + (calls[250][2] + 5,)                      # in flight over the last pause
    df = spark.createDataFrame([(i, n, ts(a), ok, ts(b)) for i, n, a, ok, b in calls],
                               "call_id long, name string, ts timestamp_ntz, ok boolean, end_ts timestamp_ntz")
    args = dict(max_failures=3, window_s=10, open_s=30)
    got = sorted(tuple(r) for r in B.breaker_concurrent(df, **args).select("call_id", "verdict", "executed", "tripped").collect())
    seen, cut = [], B._cut_idle

    def watched(ev, name, order, expiry_us):
        out = cut(ev, name, order, expiry_us)
        seen.append(out.select("_seg").distinct().count())
        return out.withColumn("_seg", F.lit(1).cast("bigint"))              # the whole timeline as one piece
    B._cut_idle = watched
    try:
        want = sorted(tuple(r) for r in B.breaker_concurrent(df, **args).select("call_id", "verdict", "executed", "tripped").collect())
    finally:
        B._cut_idle = cut
    assert seen == [3] and got == want and len(got) == 300 and any(r[3] for r in got)


def _stuck_log(spark, n):
    """``n`` notifications locked a second later; every third is delivered in the second half of the log."""
    made = spark.createDataFrame([(f"n{i}", ts(i)) for i in range(n)], "id string, created_at timestamp_ntz")
    none = spark.createDataFrame([], "id string, attempt_ts timestamp_ntz, http_status int, message_id string, attempt_no int, latency_s double")
    locks = spark.createDataFrame([(f"n{i}", ts(i + 1)) for i in range(n)], "id string, ts timestamp_ntz")
    done = spark.createDataFrame([(f"n{i}", ts(i + 2), 200, f"m{i}") for i in range(0, n, 3)],
                                 "id string, ts timestamp_ntz, http_status int, message_id string")
    from missive.operators import lifecycle as LC
    return LC.event_log(made, none, none.selectExpr("id", "attempt_ts AS ts"), locks=locks, outcomes=done)


def test_lifecycle_stream_holds_many_ids_in_few_states(spark, tmp_path):
    """Sixty ids share four keyed states over two micro-batches; every id keeps its own row and timer."""
    from missive.streaming import jobs as X
    log, src = _stuck_log(spark, 60), str(tmp_path / "log")
    log.where("kind <> 'outcome'").coalesce(1).write.parquet(src)
    log.where("kind = 'outcome'").coalesce(1).write.mode("append").parquet(src)
    late = spark.createDataFrame([("z", 0)], "id string, n int").select(
        "id", F.lit(1_800_000_000_000_000).alias("t"), F.lit(0).alias("rank"), F.lit("create").alias("kind"),
        F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("message_id"),
        F.lit(None).cast("int").alias("attempt_no"), F.lit(None).cast("double").alias("latency_s"))
    late.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = X.lifecycle_stream(stream, "1 hour", buckets=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert all(p["stateOperators"][0]["numRowsTotal"] <= 4 for p in q.recentProgress if p["stateOperators"])
    last = {r["id"]: (r["status"], r["retry_count"], r["moves"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("moves").collect()}
    # delivered ones are final; the others' five minutes end under the last event's watermark
    want = {f"n{i}": ("delivered", 0, 3) if i % 3 == 0 else ("pending", 1, 3) for i in range(60)} | {"z": ("pending", 0, 1)}
    assert last == want


def test_fold_returns_last_or_marked_rows_across_arrow_batches(spark):
    """Groups that span batches of three rows; the fold sends back only what is asked for."""
    from missive.operators.fold import stream_fold
    rows = [(k, i, None if (k + i) % 4 == 0 else i * 10, f"p{k}-{i}") for k in range(7) for i in range(1 + 3 * k)]
    df = spark.createDataFrame(rows, "k long, i long, v long, pass string")

    def step(s, v):
        s[0] += 1
        s[1] += 0 if v != v else v
        return s[1], s[0] % 3 == 0
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        run = lambda only: {tuple(r) for r in stream_fold(df, ["k"], ["i"], ["v"], lambda: [0, 0], step,
                                                          [("total", "long"), ("third", "boolean")], only=only).collect()}
        full, last, marked = run(None), run("last"), run("third")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, total = set(), {}
    for k, i, v, p in rows:
        total[k] = total.get(k, 0) + (v or 0)
        want.add((k, i, v, p, total[k], i % 3 == 2))
    assert full == want
    assert last == {r for r in want if r[1] == 3 * r[0]}
    assert marked == {r for r in want if r[5]}


def test_breaker_pieces_come_from_idle_bins(spark):
    """Two names and one without; a pause of the reset or more cuts, and the trips alone equal those of all verdicts."""
    from missive.operators.fold import segment_by_bins
    rnd, calls, t = random.Random(5), [], 0
    for i in range(200):
        t += 200_000 if i in (60, 130) else rnd.randint(100, 4000)
        calls.append((i, ("a", "b", None)[i % 3], ts(t), rnd.random() < 0.3))
    calls.append((200, "a", None, False))
    df = spark.createDataFrame(calls, "call_id long, name string, ts timestamp_ntz, ok boolean")
    args = dict(max_failures=3, window_s=10, open_s=30)
    full = {tuple(r) for r in B.breaker_replay(df, **args).select("call_id", "name", "ts", "tripped").collect()}
    trips = {tuple(r) for r in B.breaker_replay(df, trips_only=True, **args).select("call_id", "name", "ts", "tripped").collect()}
    assert len(full) == 201 and trips and trips == {r for r in full if r[3]}
    seg = segment_by_bins(df.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))), "name", "_us", 35_000_000)
    got = {(r["name"], r["_seg"]): r["n"] for r in seg.groupBy("name", "_seg").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(got.values()) == 201 and got.pop(("a", None)) == 1
    assert sorted(got, key=str) == sorted([(n, s) for n in ("a", "b", None) for s in (1, 2, 3)], key=str)


def test_breaker_stream_goes_through_a_name_in_slices(spark, tmp_path, monkeypatch):
    from missive.streaming import jobs as X
    rnd = random.Random(9)
    calls = [(i, f"h{i % 2}", ts(rnd.randint(0, 200_000)), rnd.random() < 0.4) for i in range(150)]
    df = spark.createDataFrame(calls, "call_id long, name string, ts timestamp_ntz, ok boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "calls"))
    monkeypatch.setattr(X, "BREAKER_SLICE", 7)
    s = X.breaker_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "calls")), 3, 10, 30)
    cols = ["call_id", "name", "verdict", "executed", "tripped"]
    got = {tuple(r) for r in spark.read.parquet(X.run_to_parquet(s, "t_breaker")).select(*cols).collect()}
    want = {tuple(r) for r in B.breaker_replay(df, max_failures=3, window_s=10, open_s=30).select(*cols).collect()}
    assert got == want and any(r[4] for r in got)


def test_any_before_against_pairs(spark):
    """Own bucket and the one before, both ends of the width, times before 1970, missing names and times."""
    from missive.operators.joins import any_before
    rnd = random.Random(12)
    at = lambda: rnd.choice([None, *[dt.datetime(1970, 1, 1) + dt.timedelta(seconds=rnd.randint(-300, 300)) for _ in range(9)]])
    left = [(i, rnd.choice(["a", "b", None]), at()) for i in range(300)]
    right = [(rnd.choice(["a", None, "c"]), at()) for _ in range(12)]
    fetches = spark.createDataFrame(left, "i int, name string, ts timestamp_ntz")
    trips = spark.createDataFrame(right, "name string, ts timestamp_ntz")
    width = dt.timedelta(seconds=30)
    want = {i: any(n == k and t is not None and r is not None and r <= t < r + width for k, r in right) for i, n, t in left}
    assert {r["i"]: r["breaker_open"] for r in B.breaker_open_at(fetches, trips).collect()} == want
    got = {r["i"]: r["o"] for r in any_before(fetches, trips, "name", "ts", "ts", 30, "o").where("name IS NOT NULL").collect()}
    assert got == {i: want[i] for i, n, _ in left if n is not None} and len(set(got.values())) == 2


def test_latest_answer_is_the_latest_outcome(spark):
    """Equal times and numbers, missing values, times before 1970: a status by a hash aggregate is that of the whole order."""
    from missive.operators import disposition as DS
    from missive.operators.projections import classify_http
    from missive.operators.transitions import latest_outcome
    rnd = random.Random(4)
    rows = [(f"n{rnd.randint(0, 60)}", rnd.choice([None, 1, 2, -3, 2 ** 31 - 1]),
             rnd.choice([None, dt.datetime(1960, 1, 1), T0, ts(1)]), rnd.choice([None, 200, 202, 400, 429, 500]), "", 0.1) for _ in range(300)]
    a = spark.createDataFrame(rows, "id string, attempt_no int, attempt_ts timestamp_ntz, http_status int, message_id string, latency_s double")
    answers = DS.latest_answer(a)
    got = {tuple(r) for r in answers.collect()}
    assert got == {tuple(r) for r in latest_outcome(a).select("id", classify_http("http_status")).collect()} and len(got) == len({r[0] for r in rows})
    assert "SortAggregate" not in answers._jdf.queryExecution().executedPlan().toString()


def test_trips_alone_move_the_calls_once(spark):
    """The pieces are joined without moving the calls, Python sees no ids, and passing over
    refused calls and cleared successes leaves the trips of the whole replay."""
    from missive.operators import disposition as DS
    rnd = random.Random(8)
    rows = [(f"n{i}", 1, T0 + dt.timedelta(seconds=i // 3 + 100 * (i // 400)), rnd.choice([200, 500, 500, 500]) if i % 400 < 250 else 200, "", 0.1)
            for i in range(2000)]
    a = spark.createDataFrame(rows, "id string, attempt_no int, attempt_ts timestamp_ntz, http_status int, message_id string, latency_s double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        trips = DS.webhook_breaker_trips(a)
        got = sorted(r["ts"] for r in trips.collect())
        want = sorted(r["ts"] for r in DS.webhook_replay(a).where("tripped").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want and len(got) == 10
    whole = DS.webhook_replay(a, trips_only=True, keep=["name", "ts"])
    assert set(whole.columns) == {"name", "ts", "ok", "verdict", "executed", "tripped"}
    assert trips._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    plan = trips._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_first_messages_of_repeated_ids(spark):
    from missive.operators import disposition as DS
    rows = [("m1", ts(5), "a"), ("m2", ts(3), "a"), ("m0", ts(3), "a"), ("m3", ts(1), "b"), ("m4", None, "c"), ("m5", ts(1), "c")]
    m = spark.createDataFrame(rows, "msg_id string, ts timestamp_ntz, nid string")
    assert {r["nid"]: r["_f"]["msg_id"] for r in DS.first_messages(m).collect()} == {"a": "m0", "c": "m4"}
