"""Source queries (S5, S10) and B3."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.operators import breaker as B
from missive.operators import ordering as R
from missive.operators.projections import route_priority
from missive.plans.limits import BREAKER
from missive.plans.registry import query
from missive.sources import derived as D
from missive.sources.tables import read_table

# --------------------------------------------------------------------------- S10
_GEN_SQL = """SELECT event_id AS seq,
  'gen-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS idempotency_key,
  CASE (event_id * 2654435761) % 3 WHEN 0 THEN 'sms' WHEN 1 THEN 'email' ELSE 'push' END AS channel,
  CASE (event_id * 40503) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' ELSE 'high' END AS priority,
  CASE WHEN (event_id * 2654435761) % 3 = 0 THEN '+90555' || lpad(CAST((event_id * 7919) % 10000000 AS VARCHAR), 7, '0')
       ELSE 'user_' || CAST(event_id AS VARCHAR) || '@example.com' END AS recipient,
  'load test message ' || CAST(event_id AS VARCHAR) AS content
FROM events"""


@query("gen_requests", _GEN_SQL)
def gen_requests(spark, sf):
    """Valid requests, one per event row: channel and priority spread uniformly by a
    multiplicative hash of the row number, phone or e-mail recipient, unique key."""
    e = read_table(spark, sf, "events").select("event_id")
    i = F.col("event_id")
    ch = (i * 2654435761) % 3
    pr = (i * 40503) % 3
    return e.select(
        i.alias("seq"), F.concat(F.lit("gen-"), F.lpad(i.cast("string"), 12, "0")).alias("idempotency_key"),
        F.when(ch == 0, "sms").when(ch == 1, "email").otherwise("push").alias("channel"),
        F.when(pr == 0, "low").when(pr == 1, "normal").otherwise("high").alias("priority"),
        F.when(ch == 0, F.concat(F.lit("+90555"), F.lpad(((i * 7919) % 10000000).cast("string"), 7, "0")))
         .otherwise(F.concat(F.lit("user_"), i.cast("string"), F.lit("@example.com"))).alias("recipient"),
        F.concat(F.lit("load test message "), i.cast("string")).alias("content"))


# --------------------------------------------------------------------------- S5
@query("topic_source", """SELECT topic, "partition", row_number() OVER (PARTITION BY topic, "partition"
    ORDER BY created_at, id) - 1 AS "offset", id, payload FROM (
  SELECT id, payload, created_at, CASE coalesce(payload ->> '$.priority', '') WHEN 'high' THEN 'notifications-high'
      WHEN 'low' THEN 'notifications-low' ELSE 'notifications-normal' END AS topic,
    CAST(CAST(substr(aggregate_id, 25, 12) AS BIGINT) % 3 AS INT) AS "partition"
  FROM outbox WHERE status = 'pending' AND NOT __POISON__)""",
       ("outbox",))
def topic_source(spark, sf):
    """S5 offline: routed messages with the broker's (topic, partition, offset) layout;
    offsets are dense per partition (two-pass row numbers, no single-task window)."""
    from missive.operators.joins import poison_payload
    o = D.outbox(spark, sf).where((F.col("status") == "pending") & ~poison_payload(F.col("payload")))
    pr = F.coalesce(F.get_json_object("payload", "$.priority"), F.lit(""))
    x = o.select("id", "payload", "created_at", route_priority(pr).alias("topic"),
                 (F.substring("aggregate_id", 25, 12).cast("bigint") % 3).cast("int").alias("partition"))
    r = R.global_row_number(x, ["created_at", "id"], keys=["topic", "partition"])
    return r.select("topic", "partition", (F.col("rn") - 1).alias("offset"), "id", "payload")


# --------------------------------------------------------------------------- B3
def _b3_sql(max_failures: int, window_s: int, open_s: int) -> str:
    us = "CAST(1000000 AS BIGINT)"
    alive = lambda x: f"({x} IS NOT NULL AND t < {x})"
    trips = f"(CASE WHEN {alive('fu')} THEN fails + 1 ELSE 1 END) >= {max_failures}"
    nxt = f"(CASE WHEN {alive('fu')} THEN fails + 1 ELSE 1 END)"
    # end of an executed, non-probe failing call while the breaker is closed
    closed_fail = f"(kind = 0 AND found AND NOT ok AND NOT probe AND NOT {alive('st')})"
    clear = "(kind = 0 AND found AND ok)"
    reopen = "(kind = 0 AND found AND NOT ok AND probe)"
    return f"""WITH RECURSIVE ev AS (
  SELECT name, call_id, ok, t, kind, row_number() OVER (PARTITION BY name ORDER BY t, phase, call_id) AS rn FROM (
    SELECT name, call_id, ok, epoch_us(ts) AS t, 1 AS kind, 1 AS phase FROM timed_calls
    UNION ALL SELECT name, call_id, ok, epoch_us(end_ts), 0, CASE WHEN end_ts > ts THEN 0 ELSE 2 END FROM timed_calls)),
r AS (
  SELECT name, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS st, CAST(NULL AS BIGINT) AS hf,
    CAST(NULL AS BIGINT) AS pr, 0 AS fails, CAST(NULL AS BIGINT) AS fu,
    CAST([] AS STRUCT(cid BIGINT, probe BOOLEAN)[]) AS flight, CAST(NULL AS BIGINT) AS call_id, 0 AS kind,
    CAST(NULL AS VARCHAR) AS verdict, false AS tripped FROM (SELECT DISTINCT name FROM ev)
  UNION ALL
  SELECT name, rn,
    CASE WHEN {clear} THEN NULL WHEN {reopen} THEN t + {open_s} * {us}
         WHEN {closed_fail} AND {trips} THEN t + {open_s} * {us} ELSE st END,
    CASE WHEN {clear} THEN NULL WHEN {reopen} THEN t + {open_s + 5} * {us}
         WHEN {closed_fail} AND {trips} THEN t + {open_s + 5} * {us} ELSE hf END,
    CASE WHEN kind = 1 AND v = 'probe' THEN t + 10 * {us} WHEN {clear} OR {reopen} THEN NULL ELSE pr END,
    CASE WHEN {clear} THEN 0 WHEN {closed_fail} THEN CASE WHEN {trips} THEN 0 ELSE {nxt} END ELSE fails END,
    CASE WHEN {clear} THEN NULL WHEN {closed_fail} THEN
           CASE WHEN {trips} THEN NULL WHEN {alive('fu')} THEN fu ELSE t + {window_s} * {us} END
         ELSE fu END,
    CASE WHEN kind = 1 AND v <> 'open' THEN list_append(flight, {{'cid': call_id, 'probe': v = 'probe'}})
         WHEN kind = 0 THEN list_filter(flight, lambda x: x.cid <> call_id) ELSE flight END,
    call_id, kind, CASE WHEN kind = 1 THEN v END,
    kind = 0 AND ({reopen} OR ({closed_fail} AND {trips}))
  FROM (SELECT *, len(list_filter(flight, lambda x: x.cid = call_id)) > 0 AS found,
      coalesce(list_filter(flight, lambda x: x.cid = call_id)[1].probe, false) AS probe,
      CASE WHEN {alive('st')} THEN 'open'
           WHEN {alive('hf')} THEN CASE WHEN {alive('pr')} THEN 'open' ELSE 'probe' END
           ELSE 'closed' END AS v
    FROM (SELECT e.name, e.rn, e.call_id, e.ok, e.t, e.kind, r.st, r.hf, r.pr, r.fails, r.fu, r.flight
          FROM r JOIN ev e ON e.name = r.name AND e.rn = r.rn + 1)))
SELECT s.call_id, s.name, s.verdict, s.verdict <> 'open' AS executed, e.tripped
FROM (SELECT * FROM r WHERE rn > 0 AND kind = 1) s JOIN (SELECT * FROM r WHERE rn > 0 AND kind = 0) e
  ON e.name = s.name AND e.call_id = s.call_id"""


@query("breaker_concurrent", _b3_sql(**BREAKER), ("timed_calls",))
def breaker_concurrent(spark, sf):
    """Breaker replay over interleaved call starts and ends (probe lock held while
    a probe is in flight)."""
    c = D.timed_calls(spark, sf)
    return B.breaker_concurrent(c, **BREAKER).select("call_id", "name", "verdict", "executed", "tripped")
