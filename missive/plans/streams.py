"""Streaming queries (X1-X8): each runs a Structured Streaming job over the file source
with ``availableNow`` and returns its output read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.plans.joins import ADMITTED_SQL
from missive.plans.limits import (BREAKER, BUCKET_CAPACITY, BUCKET_RATE, SLIDING_LIMIT, SLIDING_WINDOW_MS,
                                  _SLIDING_SQL, _bucket_sql, breaker_sql)
from missive.plans.registry import query
from missive.plans.transitions import LIFECYCLE_SQL
from missive.sources import derived as D
from missive.sources.commits import committed
from missive.sources.tables import streaming_tables
from missive.streaming import jobs as X
from missive.streaming import ordered as O


@query("stream_admission", f"""SELECT '30000000-0000-4000-8000-' || lpad(CAST(seq AS VARCHAR), 12, '0') AS id,
  idempotency_key, channel FROM {ADMITTED_SQL}""", ("requests", "notifications"))
def stream_admission(spark, sf):
    existing = D.notifications(spark, sf).select("idempotency_key")
    with streaming_tables("events"):
        reqs = D.requests(spark, sf)
    out = X.admission(reqs, existing)
    return committed(spark, out, "notifications").select("id", "idempotency_key", "channel")


@query("stream_dual_write", f"""SELECT 'o-30000000-0000-4000-8000-' || lpad(CAST(seq AS VARCHAR), 12, '0') AS id,
  '30000000-0000-4000-8000-' || lpad(CAST(seq AS VARCHAR), 12, '0') AS aggregate_id FROM {ADMITTED_SQL}""",
       ("requests", "notifications"))
def stream_dual_write(spark, sf):
    """The outbox half of the dual write (same batch, same ids as the rows)."""
    existing = D.notifications(spark, sf).select("idempotency_key")
    with streaming_tables("events"):
        reqs = D.requests(spark, sf)
    out = X.admission(reqs, existing, name="dual_write")
    rows = committed(spark, out, "notifications").select("id")
    box = committed(spark, out, "outbox").select("id", "aggregate_id")
    # both or none: every outbox row has its notification row
    return box.join(rows.withColumnRenamed("id", "aggregate_id"), "aggregate_id", "left_semi")


_ROUTED = """SELECT id, CASE coalesce(payload ->> '$.priority', '') WHEN 'high' THEN 'notifications-high'
  WHEN 'low' THEN 'notifications-low' ELSE 'notifications-normal' END AS topic,
  coalesce(payload ->> '$.recipient', '') AS key, payload AS value FROM outbox
WHERE {cond} AND NOT __POISON__"""


@query("stream_route", _ROUTED.format(cond="status = 'pending'"), ("outbox",))
def stream_route(spark, sf):
    with streaming_tables("orders"):
        box = D.outbox(spark, sf)
    out = X.route(box)
    return spark.read.parquet(out).select("id", "topic", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("stream_dlq", "SELECT id FROM outbox WHERE __POISON__", ("outbox",))
def stream_dlq(spark, sf):
    with streaming_tables("orders"):
        box = D.outbox(spark, sf)
    out = X.dlq_split(box)
    return spark.read.parquet(f"{out}/dlq").select("id")


@query("stream_cancel_join", """SELECT msg_id, id, ts FROM messages m WHERE NOT EXISTS (
  SELECT 1 FROM cancels c WHERE c.id = m.id AND c.cancel_ts <= m.ts AND m.ts < c.cancel_ts + INTERVAL 24 HOUR)""",
       ("messages", "cancels"))
def stream_cancel_join(spark, sf):
    cancels = D.cancels(spark, sf)
    with streaming_tables("events"):
        msgs = D.messages(spark, sf)
    out = X.run_to_parquet(X.cancel_join_static(msgs, cancels), "cancel_join")
    return spark.read.parquet(out).select("msg_id", "id", "ts")


@query("stream_cancel_streams", """SELECT msg_id, id, ts FROM messages m WHERE ts < (
    SELECT least((SELECT max(ts) FROM messages), (SELECT max(cancel_ts) FROM cancels)) - INTERVAL 1 HOUR) AND NOT EXISTS (
  SELECT 1 FROM cancels c WHERE c.id = m.id AND c.cancel_ts <= m.ts AND m.ts < c.cancel_ts + INTERVAL 24 HOUR)""",
       ("messages", "cancels"))
def stream_cancel_streams(spark, sf):
    """X6, both sides streamed: the messages the final watermark has passed (the earlier of the
    two last event times, less the delay) that carry no live cancel flag."""
    with streaming_tables("events"):
        msgs, cancels = D.messages(spark, sf), D.cancels(spark, sf)
    out = X.run_to_parquet(X.cancel_join_stream_stream(msgs, cancels, "1 hour"), "cancel_streams")
    return spark.read.parquet(out).select("msg_id", "id", "ts")


@query("stream_metrics", """SELECT date_trunc('minute', ts) AS window_start, method, route, count(*) AS value
FROM api_log GROUP BY ALL""", ("api_log",))
def stream_metrics(spark, sf):
    with streaming_tables("events"):
        log = D.api_log(spark, sf)
    out = X.windowed_counts(log, "ts", ["method", "route"], "1 minute", "1 hour")
    r = X.latest_per_key(spark, out, ["window_start", "method", "route"])
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "method", "route", "value")


@query("stream_limits", _SLIDING_SQL, ("limiter_requests",))
def stream_limits(spark, sf):
    with streaming_tables("events"):
        reqs = D.limiter_requests(spark, sf)
    s = X.sliding_limit_stream(reqs, "key", "ts", "req_id", SLIDING_LIMIT, SLIDING_WINDOW_MS, "1 hour")
    out = X.run_to_parquet(s, "limits")
    return spark.read.parquet(out).select("req_id", "key", "allowed")


@query("stream_token_bucket", _bucket_sql("limiter_requests", BUCKET_CAPACITY, BUCKET_RATE), ("limiter_requests",))
def stream_token_bucket(spark, sf):
    with streaming_tables("events"):
        reqs = D.limiter_requests(spark, sf)
    s = X.token_bucket_stream(reqs, "key", "ts", "req_id", "weight", BUCKET_CAPACITY, BUCKET_RATE, "1 hour")
    out = X.run_to_parquet(s, "token_bucket")
    return spark.read.parquet(out).select("req_id", "key", "allowed", F.round("tokens_left", 9).alias("tokens_left"))


ORDERED_BIN_MS = 6 * 3_600_000
# the rows whose bin the final watermark (last event time less an hour) has passed
_RELEASED = f""" WHERE req_id IN (SELECT req_id FROM limiter_requests WHERE epoch_us(ts) // {ORDERED_BIN_MS * 1000}
  < ((SELECT max(epoch_ms(ts)) FROM limiter_requests) - 3600000) // {ORDERED_BIN_MS})"""


def _ordered(spark, sf, weight, limiter, name):
    with streaming_tables("events"):
        reqs = D.limiter_requests(spark, sf)
    with O.map_state(spark):
        return spark.read.parquet(X.run_to_parquet(
            O.ordered_limit_stream(reqs, "key", "ts", "req_id", weight, limiter, ORDERED_BIN_MS, "1 hour"), name))


@query("stream_limits_ordered", _SLIDING_SQL + _RELEASED, ("limiter_requests",))
def stream_limits_ordered(spark, sf):
    """X4, L2 in event-time order: the rows the final watermark has released."""
    return _ordered(spark, sf, None, O.SlidingLog(SLIDING_LIMIT, SLIDING_WINDOW_MS), "limits_ordered").select("req_id", "key", "allowed")


@query("stream_token_bucket_ordered", _bucket_sql("limiter_requests", BUCKET_CAPACITY, BUCKET_RATE) + _RELEASED, ("limiter_requests",))
def stream_token_bucket_ordered(spark, sf):
    """X4, L3 in event-time order: the rows the final watermark has released."""
    r = _ordered(spark, sf, "weight", O.TokenBucket(BUCKET_CAPACITY, BUCKET_RATE), "token_bucket_ordered")
    return r.select("req_id", "key", "allowed", F.round("tokens_left", 9).alias("tokens_left"))


@query("stream_breaker", breaker_sql("calls", **BREAKER), ("calls",))
def stream_breaker(spark, sf):
    with streaming_tables("events"):
        calls = D.calls(spark, sf)
    s = X.breaker_stream(calls, BREAKER["max_failures"], BREAKER["window_s"], BREAKER["open_s"], "2 hours")
    out = X.run_to_parquet(s, "breaker")
    return spark.read.parquet(out).select("call_id", "name", "verdict", "executed", "tripped")


LIFECYCLE_DELAY_DAYS = 3650
_FINAL_M10 = """SELECT id, status, CAST(retry AS INT) AS retry_count, make_timestamp(nxt) AS next_retry_at, ext AS external_id,
  make_timestamp(upd) AS updated_at, CAST(n AS INT) AS moves, CAST(zombies AS INT) AS zombies, CAST(refusals AS INT) AS refusals
FROM r QUALIFY en = max(en) OVER (PARTITION BY id)"""
# the stream also fires the one timer that is due when the watermark (latest event time
# minus the delay) passes it: a due retry is swept back to pending, a stuck row swept
_FINAL_STREAM = f"""SELECT id, CASE WHEN due_retry THEN 'pending' WHEN zombie THEN
      CASE WHEN retry < 3 THEN 'pending' ELSE 'failed_permanently' END ELSE status END AS status,
  CAST(CASE WHEN zombie AND retry < 3 THEN retry + 1 ELSE retry END AS INT) AS retry_count,
  make_timestamp(nxt) AS next_retry_at, ext AS external_id,
  make_timestamp(CASE WHEN due_retry THEN nxt WHEN zombie THEN upd + 300000000 ELSE upd END) AS updated_at,
  CAST(n + CASE WHEN due_retry OR zombie THEN 1 ELSE 0 END AS INT) AS moves,
  CAST(zombies + CASE WHEN zombie THEN 1 ELSE 0 END AS INT) AS zombies, CAST(refusals AS INT) AS refusals
FROM (SELECT *, status = 'failed_retrying' AND nxt < wm - 1000 AS due_retry,
    status = 'processing' AND upd + 300000000 < wm - 1000 AS zombie
  FROM (SELECT *, (SELECT max(t) FROM ev) - CAST({LIFECYCLE_DELAY_DAYS} AS BIGINT) * 86400000000 AS wm
    FROM r QUALIFY en = max(en) OVER (PARTITION BY id)))"""


@query("stream_lifecycle", LIFECYCLE_SQL.replace(_FINAL_M10, _FINAL_STREAM),
       ("notifications", "attempts", "cancel_requests"))
def stream_lifecycle(spark, sf):
    from missive.plans.transitions import worker_log
    known = D.notifications(spark, sf).select("id")          # static side of the semi join
    with streaming_tables("orders", "lineitem", "events"):
        ev = worker_log(spark, sf, known)
    out = X.run_to_parquet(X.lifecycle_stream(ev, f"{LIFECYCLE_DELAY_DAYS} days"), "lifecycle")
    r = spark.read.parquet(out)
    last = r.groupBy("id").agg(F.max_by(F.struct("status", "retry_count", "next_retry_us", "external_id",
                                                 "updated_us", "moves", "zombies", "refusals"), F.col("moves")).alias("s"))
    ts = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return last.select("id", "s.status", "s.retry_count", ts(F.col("s.next_retry_us")).alias("next_retry_at"),
                       "s.external_id", ts(F.col("s.updated_us")).alias("updated_at"), "s.moves", "s.zombies", "s.refusals")
