"""Delivery metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.operators import joins as J
from missive.operators import metrics as A
from missive.operators import transitions as M
from missive.operators.projections import route_priority
from missive.plans.joins import ADMITTED_SQL, OUTCOME_SQL, admitted
from missive.plans.registry import query
from missive.session import materialize
from missive.sources import derived as D
from missive.sources.tables import dealt_tables

AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"


def _hist_sql(src: str, labels: list[str], value: str, buckets: list[float]) -> str:
    lab = ", ".join(labels)
    sel = (lab + ", ") if labels else ""
    total = f"round(CAST(sum({value}) AS DOUBLE), 6) AS sum"
    parts = [f"SELECT {sel}'{A.le_label(b)}' AS le, CAST(count_if({value} <= {b}) AS BIGINT) AS bucket_count, "
             f"{total}, count({value}) AS count FROM {src}"
             + (f" GROUP BY {lab}" if labels else "") for b in buckets]
    parts.append(f"SELECT {sel}'+Inf' AS le, count({value}) AS bucket_count, {total}, "
                 f"count({value}) AS count FROM {src}" + (f" GROUP BY {lab}" if labels else ""))
    return "\nUNION ALL ".join(parts)


@query("http_requests_total", """SELECT method, route, status_code, count(*) AS value FROM api_log
  GROUP BY ALL""", ("api_log",))
def http_requests_total(spark, sf):
    return A.counter(D.api_log(spark, sf), ["method", "route", "status_code"])


@query("http_latency_hist", _hist_sql("api_log", ["method", "route"], "latency_s", A.API_LATENCY_BUCKETS),
       ("api_log",))
def http_latency_hist(spark, sf):
    return A.histogram(D.api_log(spark, sf), ["method", "route"], "latency_s", A.API_LATENCY_BUCKETS)


@query("created_by_channel", f"SELECT channel, count(*) AS value FROM {ADMITTED_SQL} GROUP BY channel",
       ("requests", "notifications"))
def created_by_channel(spark, sf):
    rows, _ = M.apply_create(admitted(spark, sf))
    return A.counter(rows, ["channel"])


@query("canceled_total", """SELECT count(*) AS value FROM (
  SELECT r.id, row_number() OVER (PARTITION BY r.id ORDER BY req_id) AS rn, n.status
  FROM cancel_requests r JOIN notifications n ON n.id = r.id)
  WHERE rn = 1 AND status IN ('pending', 'failed_retrying')""", ("cancel_requests", "notifications"))
def canceled_total(spark, sf):
    _new, verdict = M.apply_cancel(D.notifications(spark, sf), D.cancel_requests(spark, sf), D.AS_OF)
    return A.counter(verdict.where(F.col("result") == "canceled"), [])


def _applied(spark, sf, latest=None):
    n = D.notifications(spark, sf).withColumn("old_status", F.col("status"))
    return M.apply_outcomes(n, D.attempts(spark, sf), keep=("old_status",), latest=latest)


@query("processed_by_status", f"""SELECT CASE status WHEN 'failed_retrying' THEN 'retrying' ELSE status END AS status,
  channel, count(*) AS value FROM ({OUTCOME_SQL}) o JOIN (SELECT id, channel FROM notifications) c USING (id)
  WHERE old_status = 'processing' AND status <> 'processing' GROUP BY ALL""", ("notifications", "attempts"))
def processed_by_status(spark, sf, applied=None):
    a = applied if applied is not None else _applied(spark, sf)
    a = a.where((F.col("old_status") == "processing") & (F.col("status") != "processing"))
    a = a.withColumn("status", F.when(F.col("status") == "failed_retrying", "retrying").otherwise(F.col("status")))
    return A.counter(a, ["status", "channel"])


_ATT_CH = """(SELECT a.*, n.channel FROM attempts a JOIN notifications n ON n.id = a.id)"""


def _attempts_ch(spark, sf, more=()):
    n = D.notifications(spark, sf).select("id", "channel", *more)
    return D.attempts(spark, sf).join(n, "id")


@query("processing_latency_hist", _hist_sql(_ATT_CH.replace("n.id = a.id)", "n.id = a.id WHERE n.status <> 'canceled')"), ["channel"], "latency_s", A.PROCESSING_BUCKETS),
       ("attempts", "notifications"))
def processing_latency_hist(spark, sf):
    """Messages dropped before the call (poison, empty id: they have no attempt) and
    canceled rows are not observed."""
    reached = _attempts_ch(spark, sf, ("status",)).where(F.col("status") != "canceled")
    return A.histogram(reached, ["channel"], "latency_s", A.PROCESSING_BUCKETS)


@query("webhook_latency_hist", _hist_sql(_ATT_CH, ["channel"], "latency_s", A.WEBHOOK_BUCKETS), ("attempts", "notifications"))
def webhook_latency_hist(spark, sf):
    """Every call is observed, transport errors included."""
    return A.histogram(_attempts_ch(spark, sf), ["channel"], "latency_s", A.WEBHOOK_BUCKETS)


@query("retry_total", f"""SELECT channel, count(*) AS value FROM ({OUTCOME_SQL}) o
  JOIN (SELECT id, channel FROM notifications) c USING (id)
  WHERE old_status = 'processing' AND status = 'failed_retrying' GROUP BY channel""", ("notifications", "attempts"))
def retry_total(spark, sf, applied=None):
    a = applied if applied is not None else _applied(spark, sf)
    a = a.where((F.col("old_status") == "processing") & (F.col("status") == "failed_retrying"))
    return A.counter(a, ["channel"])


def parsed_outbox(spark, sf):
    """The outbox with each payload parsed once: poison, and the texts that the consumer reads.

    Written before anything reads it: a filter on ``poison`` would go below the parse, to the
    few tasks of the scan."""
    with dealt_tables("orders"):          # a payload is written and parsed per row
        o = D.outbox(spark, sf).select("id", "created_at", "status", "payload")
    return materialize(J.parse_payload(o, "payload", {"nid": "id", "channel": "channel", "priority": "priority"}), "outbox_parsed")


@query("consumed_by_topic", """SELECT CASE coalesce(payload ->> '$.priority', '') WHEN 'high' THEN 'notifications-high'
  WHEN 'low' THEN 'notifications-low' ELSE 'notifications-normal' END AS topic, count(*) AS value
FROM outbox WHERE NOT __POISON__ GROUP BY 1""", ("outbox",))
def consumed_by_topic(spark, sf, parsed=None):
    o = parsed if parsed is not None else parsed_outbox(spark, sf)
    return A.counter(o.where("NOT poison").withColumn("topic", route_priority("priority")), ["topic"])


@query("zombie_recovered", f"""SELECT count(*) AS value FROM notifications WHERE status = 'processing'
  AND updated_at < {AS_OF_SQL} - INTERVAL 5 MINUTE AND retry_count < 3""", ("notifications",))
def zombie_recovered(spark, sf):
    _new, out = M.sweep_zombies(D.notifications(spark, sf), D.AS_OF)
    return A.counter(out, [])


@query("outbox_depth", "SELECT count(*) AS value FROM outbox WHERE status = 'pending'", ("outbox",))
def outbox_depth(spark, sf):
    return A.counter(D.outbox(spark, sf).where(F.col("status") == "pending"), [])
