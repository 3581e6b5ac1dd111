"""Structured Streaming counterparts.

Every job reads its inputs with the file source (``streaming_tables``), runs with
``trigger(availableNow=True)`` and keeps its checkpoint and output under the shared
``spark.checkpoint.dir``, so a restarted job resumes from its offsets and state.  Sinks
that must stay idempotent go through ``foreachBatch``: the dual write publishes both tables of
a batch by one manifest, the others write one folder per batch id, overwritten on replay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from missive.operators import joins as J
from missive.operators import validate as V
from missive.operators.projections import payload_json, route_priority
from missive.session import ensure_checkpoint_dir, ship_package
from missive.sources.commits import commit_tables, committed


def run_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def run_to_parquet(df: DataFrame, name: str, mode: str = "append", partition_by=None) -> str:
    """Run a stream to completion of the available input into a Parquet folder."""
    spark = df.sparkSession
    d = run_dir(spark, name)
    w = df.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ckpt")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return f"{d}/out"


def run_foreach_batch(df: DataFrame, name: str, fn, mode: str = "append") -> str:
    """Run a stream through ``fn(batch_df, batch_id, out_dir)``; returns the output dir."""
    spark = df.sparkSession
    d = run_dir(spark, name)
    out = f"{d}/out"
    (df.writeStream.foreachBatch(lambda b, i: fn(b, i, out)).option("checkpointLocation", f"{d}/ckpt")
       .outputMode(mode).trigger(availableNow=True).start().awaitTermination())
    return out


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent per-batch write: a replayed batch id overwrites its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")


# ----------------------------------------------------------------------- X1 admission
def admission(requests: DataFrame, existing_keys: DataFrame, name: str = "admission") -> str:
    """X1 + S8: validate, keep the first arrival of each key, drop keys already taken (by
    the table or by earlier batches), and write notifications + outbox as one commit per batch
    (``sources.commits``; read them with ``committed``).

    Exact and unbounded (keys are kept for ever, as the reference's unique index does):
    each batch anti-joins the keys written so far.  For a bounded-state variant see
    ``admission_bounded``.
    """
    valid = V.validate_requests(requests).where(F.col("error").isNull()).drop("error")

    def fn(batch: DataFrame, batch_id: int, out: str) -> None:
        first = batch.groupBy("idempotency_key").agg(F.min("seq").alias("seq"))
        b = batch.join(first, ["idempotency_key", "seq"], "left_semi")
        b = b.join(existing_keys, "idempotency_key", "left_anti")
        seen = committed(batch.sparkSession, out, "notifications")     # a read error stops the stream
        if seen is not None:
            b = b.join(seen.select("idempotency_key"), "idempotency_key", "left_anti")
        from missive.operators.transitions import apply_create
        b = b.persist()
        rows, outbox = apply_create(b)
        commit_tables(out, f"batch-{batch_id}", {"notifications": rows, "outbox": outbox})
        b.unpersist()

    return run_foreach_batch(valid, name, fn)


def admission_bounded(requests: DataFrame, horizon: str = "24 hours") -> DataFrame:
    """X1 with bounded state: duplicates are dropped only within the watermark horizon."""
    valid = V.validate_requests(requests).where(F.col("error").isNull()).drop("error")
    # event time for the watermark must be TIMESTAMP; arrival times are UTC wall clock
    return (valid.withColumn("_ets", F.col("arrival_ts").cast("timestamp"))
                 .withWatermark("_ets", horizon)
                 .dropDuplicatesWithinWatermark(["idempotency_key"]).drop("_ets"))


# ------------------------------------------------------------------------ X2 routing
def route(outbox: DataFrame, name: str = "route") -> str:
    """X2 + S6: pending outbox rows -> topic rows (key = recipient, value = payload),
    poison payloads dropped (D3); offline sink partitioned by topic."""
    ok = outbox.where((F.col("status") == "pending") & ~J.poison_payload(F.col("payload")))
    pr = F.coalesce(F.get_json_object("payload", "$.priority"), F.lit(""))
    rows = ok.select("id", route_priority(pr).alias("topic"),
                     F.encode(F.coalesce(F.get_json_object("payload", "$.recipient"), F.lit("")), "UTF-8")
                      .alias("key"), F.encode("payload", "UTF-8").alias("value"))
    return run_to_parquet(rows, name, partition_by=["topic"])


# ------------------------------------------------------------------------ X8 DLQ split
def dlq_split(outbox: DataFrame, name: str = "dlq") -> str:
    """X8 + S7: one pass, two sinks per batch: unparsable payloads to the DLQ, the rest
    to the topic table."""
    marked = outbox.withColumn("poison", J.poison_payload(F.col("payload")))

    def fn(batch: DataFrame, batch_id: int, out: str) -> None:
        b = batch.persist()
        _write_batch(b.where("poison").select("id", "payload"), f"{out}/dlq", batch_id)
        pr = F.coalesce(F.get_json_object("payload", "$.priority"), F.lit(""))
        _write_batch(b.where("NOT poison").select("id", route_priority(pr).alias("topic"), "payload"),
                     f"{out}/topics", batch_id)
        b.unpersist()

    return run_foreach_batch(marked, name, fn)


# ------------------------------------------------------------------ X6 cancel join
def cancel_join_static(messages: DataFrame, cancels: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """X6, stream-static: drop streamed messages with a live cancel flag (left anti join
    with a time-range condition; no state)."""
    c = cancels.select(F.col("id").alias("_cid"), "cancel_ts")
    cond = ((messages["id"] == c["_cid"]) & (c["cancel_ts"] <= messages["ts"])
            & (messages["ts"] < c["cancel_ts"] + F.expr(f"INTERVAL {ttl_hours} HOURS")))
    return messages.join(c, cond, "left_anti")


def cancel_join_stream_stream(messages: DataFrame, cancels: DataFrame, delay: str = "1 hour",
                              ttl_hours: int = 24) -> DataFrame:
    """X6, stream-stream: left outer interval join with watermarks on both sides; rows
    without a live flag come out once the watermark passes their interval."""
    # event time for watermarks must be TIMESTAMP; the wall-clock inputs are UTC
    m = messages.withColumn("_mt", F.col("ts").cast("timestamp")).withWatermark("_mt", delay)
    c = (cancels.select(F.col("id").alias("_cid"), F.col("cancel_ts").cast("timestamp").alias("_ct"))
         .withWatermark("_ct", delay))
    cond = ((m["id"] == c["_cid"]) & (c["_ct"] <= m["_mt"])
            & (m["_mt"] < c["_ct"] + F.expr(f"INTERVAL {ttl_hours} HOURS")))
    return m.join(c, cond, "leftOuter").where(F.col("_cid").isNull()).drop("_cid", "_ct", "_mt")


# ------------------------------------------------------------------ X7 windowed metrics
def windowed_counts(events: DataFrame, ts: str, labels: list[str], width: str = "1 minute",
                    delay: str = "1 hour", name: str = "metrics") -> str:
    """Counts per tumbling window and labels; update mode through ``foreachBatch``
    (each batch's changed windows, tagged with the batch id); rows later than the
    watermark are dropped, by the engine's rule."""
    e = events.withColumn("_ets", F.col(ts).cast("timestamp"))      # event time must be TIMESTAMP
    agg = (e.withWatermark("_ets", delay).groupBy(F.window("_ets", width).alias("w"), *labels)
           .agg(F.count(F.lit(1)).alias("value")))
    flat = agg.select(F.col("w.start").alias("window_start"), *labels, "value")

    def fn(batch: DataFrame, batch_id: int, out: str) -> None:
        _write_batch(batch, out, batch_id)

    return run_foreach_batch(flat, name, fn, mode="update")


def windowed_samples(all_facts: DataFrame, slots: int, width: str = "1 hour", delay: str = "1 hour", name: str = "samples") -> str:
    """Every metric per tumbling window from one keyed state: facts of ``exposition.facts``
    (with ``ts``) grouped by (window, metric, labels), the bucket counts of histograms beside
    their sums.  Update mode, each batch's changed groups tagged with the batch id."""
    from missive.operators.exposition import buffers
    g = all_facts.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "metric", "labels").agg(*buffers(slots))
    flat = g.select(F.col("w.start").alias("window_start"), *[c for c in g.columns if c != "w"])
    return run_foreach_batch(flat, name, lambda batch, batch_id, out: _write_batch(batch, out, batch_id), mode="update")


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Read an update-mode output and keep the last value written per key."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c not in keys and c != "micro_batch"]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("micro_batch")).alias("_l"))
    return g.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in cols])


# --------------------------------------------------------------- X4 / X5 keyed state
def sliding_limit_stream(reqs: DataFrame, key: str, ts: str, order: str, limit: int,
                         window_ms: int, delay: str = "1 hour") -> DataFrame:
    """L2 per key with the admitted log as keyed state (at most ``limit`` entries);
    the state expires by event-time timeout one window after its last entry."""
    ship_package(reqs.sparkSession)
    d = (reqs.withColumn("_ms", F.expr(f"unix_millis(cast({ts} as timestamp))"))
             .withColumn("_ets", F.col(ts).cast("timestamp"))
             .withWatermark("_ets", delay).select(key, order, "_ets", "_ms"))
    out_schema = T.StructType([T.StructField(order, T.LongType()), T.StructField(key, T.StringType()),
                               T.StructField("allowed", T.BooleanType())])
    state_schema = T.StructType([T.StructField("log", T.ArrayType(T.LongType()))])

    def fn(k, it: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(it)).sort_values(["_ms", order], kind="stable")
        allowed = []
        for ms in pdf["_ms"].tolist():
            log = [x for x in log if x > ms - window_ms]
            if len(log) < limit:
                log.append(ms)
                allowed.append(True)
            else:
                allowed.append(False)
        state.update((log,))
        if log:
            state.setTimeoutTimestamp(int(log[-1]) + window_ms)
        yield pd.DataFrame({order: pdf[order].astype("int64"), key: k[0], "allowed": allowed})

    return d.groupBy(key).applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                GroupStateTimeout.EventTimeTimeout)


def token_bucket_stream(reqs: DataFrame, key: str, ts: str, order: str, weight: str, capacity: float,
                        rate: float, delay: str = "1 hour") -> DataFrame:
    """L3 per key with the tokens and the last refill as keyed state; the state expires
    by event-time timeout when the bucket is full again, which equals a new key."""
    from missive.operators.token_bucket import amounts
    ship_package(reqs.sparkSession)
    unit, p, cap = amounts(capacity, rate)
    d = (reqs.withColumn("_ets", F.col(ts).cast("timestamp")).withColumn("_us", F.unix_micros("_ets"))
             .withColumn("_w", F.col(weight).cast("bigint") * unit)
             .withWatermark("_ets", delay).select(key, order, "_ets", "_us", "_w"))
    out_schema = T.StructType([T.StructField(order, T.LongType()), T.StructField(key, T.StringType()),
                               T.StructField("allowed", T.BooleanType()), T.StructField("tokens_left", T.DoubleType())])
    state_schema = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("last", T.LongType())])

    def fn(k, it: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (cap, None)
        pdf = pd.concat(list(it)).sort_values(["_us", order], kind="stable")
        allowed, left = [], []
        for us, w in zip(pdf["_us"].tolist(), pdf["_w"].tolist()):
            if last is not None:
                tokens = min(cap, tokens + max(0, us - last) * p)
            last = us
            allowed.append(tokens >= w)
            if tokens >= w:
                tokens -= w
            left.append(tokens / unit)
        state.update((tokens, last))
        full_ms = (last + -(-cap // p)) // 1000 + 1000
        state.setTimeoutTimestamp(max(full_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({order: pdf[order].astype("int64"), key: k[0], "allowed": allowed, "tokens_left": left})

    return d.groupBy(key).applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                GroupStateTimeout.EventTimeTimeout)


BREAKER_SLICE = 50_000


def breaker_stream(calls: DataFrame, max_failures: int, window_s: int, open_s: int,
                   delay: str = "1 hour") -> DataFrame:
    """B1 per breaker name with its keys as state (expiry times + failure count)."""
    from missive.operators.breaker import HALF_OPEN_EXTRA_S, PROBE_LOCK_S, _alive
    ship_package(calls.sparkSession)
    d = (calls.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
              .withColumn("_ets", F.col("ts").cast("timestamp"))
              .withWatermark("_ets", delay).select("name", "call_id", "_ets", "ok", "_us"))
    out_schema = T.StructType([T.StructField("call_id", T.LongType()), T.StructField("name", T.StringType()),
                               T.StructField("verdict", T.StringType()),
                               T.StructField("executed", T.BooleanType()),
                               T.StructField("tripped", T.BooleanType())])
    state_schema = T.StructType([T.StructField(n, T.LongType()) for n in
                                 ("state", "half", "probe", "fails", "fails_until")])

    def fn(k, it, state):
        if state.hasTimedOut:
            state.remove()
            return
        st = dict(zip(("state", "half", "probe", "fails", "fails_until"), state.get)) if state.exists \
            else {"state": None, "half": None, "probe": None, "fails": 0, "fails_until": None}
        # a name's calls are held as plain arrays (no row objects, no names) and go out in slices
        parts = [(pdf["_us"].to_numpy("float64" if pdf["_us"].hasnans else "int64"), pdf["call_id"].to_numpy("int64"),
                  pdf["ok"].to_numpy()) for pdf in it]
        us, ids, oks = (np.concatenate(x) for x in zip(*parts))
        del parts
        along = np.lexsort((ids, us))              # missing times last
        for lo in range(0, len(along), BREAKER_SLICE):
            at = along[lo:lo + BREAKER_SLICE]
            st, out = replay(st, us[at].tolist(), oks[at].tolist())
            yield pd.DataFrame({"call_id": ids[at], "name": k[0], "verdict": [o[0] for o in out],
                                "executed": [o[1] for o in out], "tripped": [o[2] for o in out]})
        state.update(tuple(st[n] for n in ("state", "half", "probe", "fails", "fails_until")))
        ends = [x for x in (st["state"], st["half"], st["probe"], st["fails_until"]) if x is not None]
        if ends:
            state.setTimeoutTimestamp(int(max(ends)) // 1000)

    def replay(st, times, goods):
        out = []
        for t, good in zip(times, goods):
            trip = False
            if _alive(st["state"], t):
                v = "open"
            elif _alive(st["half"], t):
                v = "open" if _alive(st["probe"], t) else "probe"
                if v == "probe":
                    st["probe"] = t + PROBE_LOCK_S * 1_000_000
            else:
                v = "closed"
            run = v != "open"
            if run and good:
                st = {"state": None, "half": None, "probe": None, "fails": 0, "fails_until": None}
            elif run and v == "probe":
                st.update(state=t + open_s * 1_000_000, half=t + (open_s + HALF_OPEN_EXTRA_S) * 1_000_000,
                          probe=None)
                trip = True
            elif run:
                if not _alive(st["fails_until"], t):
                    st["fails"], st["fails_until"] = 1, t + window_s * 1_000_000
                else:
                    st["fails"] += 1
                if st["fails"] >= max_failures:
                    st.update(state=t + open_s * 1_000_000, half=t + (open_s + HALF_OPEN_EXTRA_S) * 1_000_000,
                              fails=0, fails_until=None)
                    trip = True
            out.append((v, run, trip))
        return st, out

    return d.groupBy("name").applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                   GroupStateTimeout.EventTimeTimeout)


# --------------------------------------------------------------------- X3 lifecycle
LIFECYCLE_BUCKETS = 4096


def lifecycle_stream(events: DataFrame, delay: str = "3650 days", buckets: int = LIFECYCLE_BUCKETS) -> DataFrame:
    """The M10 fold per notification with its row as keyed state; the next timer
    (retry due, or five minutes in processing) is an event-time timeout that applies
    the sweep when the watermark passes it.  Emits the row after each batch.

    The state is keyed by a hash of the id: a call into Python costs milliseconds however few
    rows it gets, so one call handles the ids of a bucket.  A bucket holds its live rows column
    by column, each with its own timer, and the timeout of the bucket is the earliest of them.

    A row in a terminal status (delivered, failed for good, canceled) is emitted for the last
    time and its state removed, so the state holds live rows only; what comes later for its
    id finds no row and moves nothing (ids are created once)."""
    from missive.operators import lifecycle as LC
    ship_package(events.sparkSession)
    d = events.withColumn("ets", F.timestamp_micros("t").cast("timestamp")).withWatermark("ets", delay)
    d = d.withColumn("bucket", F.pmod(F.hash("id"), F.lit(buckets)))
    fields = [("status", T.StringType()), ("retry_count", T.IntegerType()), ("next_retry_us", T.LongType()),
              ("external_id", T.StringType()), ("updated_us", T.LongType()), ("moves", T.IntegerType()),
              ("zombies", T.IntegerType()), ("refusals", T.IntegerType())]
    names = ("status", "retry", "next", "ext", "upd", "n", "zombies", "refusals")
    out_schema = T.StructType([T.StructField("id", T.StringType())] +
                              [T.StructField(n, t) for n, t in fields])
    state_schema = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in
                                 [("id", T.StringType()), *fields, ("timer_ms", T.LongType())]])

    def fn(k, it, state):
        mark = state.getCurrentWatermarkMs()
        live = {}                                  # id -> (row, its timer)
        if state.exists:
            for i, *values, timer in zip(*state.get):
                live[i] = (dict(zip(names, values)), timer)
        logs = {}
        if not state.hasTimedOut:
            for pdf in it:
                for i, *row in zip(*[pdf[c].tolist() for c in ("id", "t", "rank", "attempt_no", "http_status",
                                                               "message_id", "latency_s", "kind")]):
                    logs.setdefault(i, []).append(row)
        moved = []
        for i, (s, timer) in list(live.items()):   # timers of rows without events
            if i not in logs and timer is not None and timer < mark:
                LC.apply_timers(s, mark * 1000)
                moved.append((i, s))
        for i, rows in logs.items():
            s = live[i][0] if i in live else LC.new_row()
            if len(rows) > 1:                      # total order; nulls first, as in the batch fold
                rows.sort(key=lambda r: tuple((0, 0) if x is None or x != x else (1, x) for x in r[:6]))
            for t, _rank, _no, http, mid, _lat, kind in rows:
                LC.apply_event(s, t, kind, http, mid)
            if s["status"] is not None:
                moved.append((i, s))
        for i, s in moved:
            if s["status"] in LC.TERMINAL:
                live.pop(i, None)
            else:
                due = LC.next_timer(s)
                live[i] = (s, None if due is None else max(due // 1000 + 1, mark + 1))
        if live:
            state.update(([*live], *[[s[n] for s, _timer in live.values()] for n in names],
                          [timer for _s, timer in live.values()]))
            timers = [timer for _s, timer in live.values() if timer is not None]
            if timers:
                state.setTimeoutTimestamp(min(timers))
        elif state.exists:
            state.remove()
        if moved:
            yield pd.DataFrame({"id": pd.Series([i for i, _s in moved], dtype=object),
                                **{f: pd.Series([s[n] for _i, s in moved], dtype=object)
                                   for (f, _t), n in zip(fields, names)}})

    return d.groupBy("bucket").applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                     GroupStateTimeout.EventTimeTimeout)


def payload_of(df: DataFrame) -> DataFrame:
    """Helper for tests: the message payload of notification rows."""
    return df.select("id", payload_json().alias("payload"))
