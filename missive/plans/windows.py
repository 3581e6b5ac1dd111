"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.operators import joins as J
from missive.operators import offsets as O
from missive.operators import ordering as R
from missive.plans.registry import query
from missive.sources import derived as D

EPOCH_SEC_SQL = "CAST(epoch_us(ts) // 1000000 AS BIGINT)"


@query("fixed_window_rank", f"""SELECT req_id, key, {EPOCH_SEC_SQL} AS sec,
  row_number() OVER (PARTITION BY key, {EPOCH_SEC_SQL} ORDER BY ts, req_id) AS n FROM limiter_requests""",
       ("limiter_requests",))
def fixed_window_rank(spark, sf):
    from missive.operators.limits import fixed_window_rank as fw
    return fw(D.limiter_requests(spark, sf), "key", "ts", "req_id").select("req_id", "key", "sec", "n")


@query("commit_watermark", """SELECT topic, "partition", "offset",
  nullif(max(coalesce(done_rank, 9223372036854775807)) OVER (PARTITION BY topic, "partition" ORDER BY "offset"
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9223372036854775807) AS commit_rank
FROM offset_log""", ("offset_log",))
def commit_watermark(spark, sf):
    return O.commit_watermark(D.offset_log(spark, sf)).select("topic", "partition", "offset", "commit_rank")


@query("committed_offsets", """SELECT topic, "partition", max("offset") AS committed_offset FROM (
  SELECT topic, "partition", "offset", max(coalesce(done_rank, 9223372036854775807)) OVER (
    PARTITION BY topic, "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
  FROM offset_log) WHERE r < 9223372036854775807 GROUP BY topic, "partition\"""", ("offset_log",))
def committed_offsets(spark, sf):
    return O.committed_offsets(O.commit_watermark(D.offset_log(spark, sf)))


_GAUGE_SQL = """(SELECT topic, tracked_at AS ts, 1 AS delta FROM offset_log
  UNION ALL SELECT topic, done_at, -1 FROM offset_log WHERE done_at IS NOT NULL)"""


@query("gauge_over_time", f"""SELECT topic, ts, delta, CAST(sum(delta) OVER (PARTITION BY topic ORDER BY ts, delta DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS gauge FROM {_GAUGE_SQL}""", ("offset_log",))
def gauge_over_time(spark, sf):
    return _gauge(spark, sf)


def _gauge(spark, sf, end="done_at"):
    o = D.offset_log(spark, sf)
    # +1 when a message is taken, -1 at its end; at equal time the +1 sorts first
    ev = (o.select("topic", F.col("tracked_at").alias("ts"), F.lit(1).alias("delta"))
          .unionByName(o.where(F.col(end).isNotNull())
                       .select("topic", F.col(end).alias("ts"), F.lit(-1).alias("delta"))))
    res = R.binned_running(ev, ["topic"], [F.col("ts"), F.col("delta").desc()],
                           F.date_trunc("hour", F.col("ts")), F.col("delta"), "sum", "gauge")
    return res.select("topic", "ts", "delta", F.col("gauge").cast("bigint").alias("gauge"))


@query("active_workers", f"""SELECT topic, max(gauge) AS peak, arg_max(gauge, (ts, -delta)) AS last_value FROM (
  SELECT topic, ts, delta, CAST(sum(delta) OVER (PARTITION BY topic ORDER BY ts, delta DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS gauge FROM {_GAUGE_SQL}) GROUP BY topic""", ("offset_log",))
def active_workers(spark, sf):
    """Gauge per topic over time (W3); peak and final value."""
    g = _gauge(spark, sf)
    return g.groupBy("topic").agg(F.max("gauge").alias("peak"),
                                  F.max_by("gauge", F.struct("ts", (-F.col("delta")).alias("d"))).alias("last_value"))


_INFLIGHT_SQL = """(SELECT topic, tracked_at AS ts, 1 AS delta FROM offset_log
  UNION ALL SELECT topic, picked_at, -1 FROM offset_log WHERE picked_at IS NOT NULL)"""


@query("inflight", f"""SELECT topic, CAST(max(gauge) AS BIGINT) AS peak, CAST(arg_max(gauge, (ts, -delta)) AS BIGINT) AS value FROM (
  SELECT topic, ts, delta, sum(delta) OVER (PARTITION BY topic ORDER BY ts, delta DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gauge FROM {_INFLIGHT_SQL}) GROUP BY topic""", ("offset_log",))
def inflight(spark, sf):
    """The gauge rises when a message is fetched and falls when a worker picks it up;
    its peak and final value per topic."""
    g = _gauge(spark, sf, "picked_at")
    return g.groupBy("topic").agg(F.max("gauge").alias("peak"),
                                  F.max_by("gauge", F.struct("ts", (-F.col("delta")).alias("d"))).alias("value"))


_RELAY_SQL = """(SELECT id, payload, row_number() OVER (ORDER BY created_at, id) AS rn FROM outbox WHERE status = 'pending')"""


@query("relay_batches", f"""SELECT id, rn, (rn - 1) // 100 AS batch_no FROM {_RELAY_SQL}""", ("outbox",))
def relay_batches(spark, sf):
    return _relay(spark, sf).select("id", "rn", "batch_no")


def _relay(spark, sf, parsed=None):
    o = D.outbox(spark, sf) if parsed is None else parsed
    o = o.where(F.col("status") == "pending").select("id", "payload" if parsed is None else "poison", "created_at")
    r = R.global_row_number(o, ["created_at", "id"])
    return r.withColumn("batch_no", F.floor((F.col("rn") - 1) / 100).cast("bigint"))


@query("relayed_total", f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS value FROM (
  SELECT (rn - 1) // 100 AS b, count(*) AS n, bool_and(poison) AS all_poison FROM (
    SELECT rn, __POISON__ AS poison
    FROM {_RELAY_SQL}) GROUP BY b) WHERE NOT all_poison""", ("outbox",))
def relayed_total(spark, sf, parsed=None):
    """Rows counted per relay batch; all-poison batches are not counted."""
    r = _relay(spark, sf, parsed) if parsed is not None else _relay(spark, sf).withColumn("poison", J.poison_payload(F.col("payload")))
    b = r.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), F.bool_and("poison").alias("all_poison"))
    return b.where(~F.col("all_poison")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("value"))


@query("transition_lag", """SELECT id, seq, status, lag(status) OVER (PARTITION BY id ORDER BY seq) AS prev_status
FROM transitions""", ("transitions",))
def transition_lag(spark, sf):
    from missive.operators.audit import with_previous
    return with_previous(D.transitions(spark, sf)).select("id", "seq", "status", "prev_status")


@query("page_number", """SELECT id, status, channel, rn, (rn - 1) // 10 + 1 AS page FROM (
  SELECT id, status, channel, row_number() OVER (PARTITION BY status, channel ORDER BY created_at DESC, id DESC) AS rn
  FROM notifications)""", ("notifications",))
def page_number(spark, sf):
    n = D.notifications(spark, sf).select("id", "status", "channel", "created_at")
    r = R.global_row_number(n, ["created_at", "id"], keys=["status", "channel"], descending=True)
    return r.select("id", "status", "channel", "rn",
                    (F.floor((F.col("rn") - 1) / 10) + 1).cast("bigint").alias("page"))
