"""Metrics export (S11): all twenty metrics as exposition samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.operators import api_calls as AC
from missive.operators import exposition as E
from missive.operators import metrics as A
from missive.plans import api, dispatch, joins, limits, metrics, transitions, windows  # noqa: F401  (their queries and SQL)
from missive.plans.oracle_views import with_views
from missive.plans.registry import ORACLE, QUERIES, query
from missive.session import materialize
from missive.sources import derived as D
from missive.sources.tables import streaming_tables
from missive.streaming import jobs as X

# Metric names of the reference, their labels, and the query each is read from
# (its value column last).
COUNTERS = [
    ("api_http_requests_total", ["method", "route", "status_code"], "http_requests_total", "value"),
    ("notification_created_total", ["channel"], "created_by_channel", "value"),
    ("notification_canceled_total", [], "canceled_total", "value"),
    ("rate_limit_hits_total", ["limiter_type"], "rate_limit_hits", "value"),
    ("notification_events_processed_total", ["status", "channel"], "processed_by_status", "value"),
    ("webhook_calls_total", ["channel", "result"], "webhook_calls", "value"),
    ("notification_retry_total", ["channel"], "retry_total", "value"),
    ("notification_active_workers", ["topic"], "active_workers", "last_value"),
    ("kafka_messages_consumed_total", ["topic"], "consumed_by_topic", "value"),
    ("kafka_dlq_messages_total", [], "dlq_total", "value"),
    ("notification_inflight_messages", ["topic"], "inflight", "value"),
    ("notification_outbox_queue_depth", [], "outbox_depth", "value"),
    ("outbox_relayed_total", [], "relayed_total", "value"),
    ("notification_zombie_recovered_total", [], "zombie_recovered", "value"),
    ("circuit_breaker_state", ["name"], "breaker_state", "value"),
    ("circuit_breaker_trips_total", [], "breaker_trips", "value"),
]
# metric, labels, observation, bounds, rows in SQL
HISTOGRAMS = [
    ("api_request_duration_seconds", ["method", "route"], "latency_s", A.API_LATENCY_BUCKETS, "api_log"),
    ("notification_batch_size", [], "size", A.BATCH_SIZE_BUCKETS, "sizes"),
    ("notification_processing_duration_seconds", ["channel"], "latency_s", A.PROCESSING_BUCKETS,
     "(SELECT a.*, n.channel FROM attempts a JOIN notifications n ON n.id = a.id WHERE n.status <> 'canceled')"),
    ("webhook_call_duration_seconds", ["channel"], "latency_s", A.WEBHOOK_BUCKETS, "(SELECT a.*, n.channel FROM attempts a JOIN notifications n ON n.id = a.id)"),
]
# the export's dispositions are those of the fixture's channel limit, as in its other counters
_COUNTER_SQL = ORACLE | {"dlq_total": with_views(dispatch.DLQ_SQL, *dispatch._DLQ_VIEWS)}
_SQL = f"WITH sizes AS MATERIALIZED {api._COMMITTED}\n" + "\nUNION ALL ".join(
    [E.sample_sql(m, f"({_COUNTER_SQL[key]})", labels, value, None) for m, labels, key, value in COUNTERS]
    + [E.sample_sql(m, rows, labels, value, bounds) for m, labels, value, bounds, rows in HISTOGRAMS])


@query("metrics_export", _SQL, ("api_log", "attempts", "notifications", "batch_json"))
def metrics_export(spark, sf):
    """Every metric's facts in one aggregate; counters and gauges that are results of
    other rules come from those rules' queries (a handful of rows each)."""
    api_ = api.decoded(spark, sf)
    verdicts = materialize(AC.quota(api_.calls, api.API_CAPACITY, api.API_RATE), "quota")
    sizes = AC.committed(api_, verdicts, D.notifications(spark, sf)).where(F.col("call_id").startswith("b-"))
    # what several metrics read is worked out once: webhook calls replayed and named, hook calls replayed,
    # payloads parsed, latest attempts, dispositions, outcomes
    calls = materialize(dispatch.named_calls(spark, sf), "named_calls")
    attempts = calls.where("known").select("channel", "status", "latency_s")
    rows = {"api_request_duration_seconds": D.api_log(spark, sf), "notification_batch_size": sizes.select(F.col("weight").alias("size")),
            "notification_processing_duration_seconds": attempts.where(F.col("status") != "canceled"), "webhook_call_duration_seconds": attempts}
    hooks = materialize(limits._replay(spark, sf), "hook_replay")
    latest = materialize(transitions.M.latest_outcome(D.attempts(spark, sf)), "latest_outcome")
    applied = materialize(metrics._applied(spark, sf, latest).select("id", "old_status", "status", "channel"), "applied")
    parsed = metrics.parsed_outbox(spark, sf)
    decided = materialize(dispatch.disposition(spark, sf, calls.where("tripped").select("name", "ts"), parsed=parsed, latest=latest), "decided")
    at_hand = {"rate_limit_hits": api.hits(spark, sf, verdicts, decided),
               "webhook_calls": dispatch.webhook_calls(spark, sf, calls.where("known")),
               "consumed_by_topic": metrics.consumed_by_topic(spark, sf, parsed), "relayed_total": windows.relayed_total(spark, sf, parsed),
               "breaker_trips": limits.breaker_trips(spark, sf, hooks), "breaker_state": limits.breaker_state(spark, sf, hooks),
               "processed_by_status": metrics.processed_by_status(spark, sf, applied),
               "retry_total": metrics.retry_total(spark, sf, applied),
               "dlq_total": A.counter(decided.where(F.col("disposition").startswith("dlq")), [])}
    out = [E.facts(at_hand[key] if key in at_hand else QUERIES[key](spark, sf), metric, labels, value) for metric, labels, key, value in COUNTERS]
    slots = max(len(bounds) for _m, _l, _v, bounds, _r in HISTOGRAMS)
    observed = [E.tallied(rows[metric], metric, labels, value, bounds, slots) for metric, labels, value, bounds, _sql in HISTOGRAMS]
    return E.expose(out, slots, more=observed)


# --------------------------------------------------------------------------- X7
# metric, labels, value, bounds, rows in SQL (with ts)
STREAMED = [
    ("api_http_requests_total", ["method", "route", "status_code"], None, None, "api_log"),
    ("api_request_duration_seconds", ["method", "route"], "latency_s", A.API_LATENCY_BUCKETS, "api_log"),
    ("kafka_messages_consumed_total", ["topic"], None, None, "(SELECT topic, tracked_at AS ts FROM offset_log)"),
    ("notification_active_workers", ["topic"], "delta", None, """(SELECT topic, tracked_at AS ts, 1 AS delta FROM offset_log
  UNION ALL SELECT topic, done_at, -1 FROM offset_log WHERE done_at IS NOT NULL)"""),
    ("notification_inflight_messages", ["topic"], "delta", None, """(SELECT topic, tracked_at AS ts, 1 AS delta FROM offset_log
  UNION ALL SELECT topic, picked_at, -1 FROM offset_log WHERE picked_at IS NOT NULL)"""),
    ("webhook_calls_total", ["name", "result"], None, None, "(SELECT name, CASE WHEN ok THEN 'success' ELSE 'error' END AS result, ts FROM calls)"),
]
_STREAM_SQL = "\nUNION ALL ".join(E.sample_sql(m, f"(SELECT *, date_trunc('hour', ts) AS window_start FROM {rows})", labels, value, bounds, "window_start")
                                  for m, labels, value, bounds, rows in STREAMED)


@query("stream_exposition", _STREAM_SQL, ("api_log", "offset_log", "calls"))
def stream_exposition(spark, sf):
    """Counters, gauge changes and histograms per hour from one keyed state over the union
    of their fact streams."""
    with streaming_tables("events"):
        log, calls, o = D.api_log(spark, sf), D.calls(spark, sf), D.offset_log(spark, sf)

    def steps(end: str):
        up = o.select("topic", F.col("tracked_at").alias("ts"), F.lit(1).alias("delta"))
        return up.unionByName(o.where(F.col(end).isNotNull()).select("topic", F.col(end).alias("ts"), F.lit(-1).alias("delta")))

    rows = {"api_http_requests_total": log, "api_request_duration_seconds": log,
            "kafka_messages_consumed_total": o.select("topic", F.col("tracked_at").alias("ts")),
            "notification_active_workers": steps("done_at"), "notification_inflight_messages": steps("picked_at"),
            "webhook_calls_total": calls.select("name", F.when(F.col("ok"), "success").otherwise("error").alias("result"), "ts")}
    facts = E.union([E.facts(rows[m], m, labels, value, bounds, "ts") for m, labels, value, bounds, _sql in STREAMED])
    slots = max(len(bounds or []) for _m, _l, _v, bounds, _r in STREAMED)
    g = X.latest_per_key(spark, X.windowed_samples(facts, slots), ["window_start", "metric", "labels"])
    out = E.samples(g, slots, ["window_start"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
