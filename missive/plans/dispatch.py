"""Disposition of consumed messages (D4), the flagship composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.operators import disposition as DS
from missive.operators import metrics as A
from missive.plans.limits import breaker_sql
from missive.plans.registry import query
from missive.sources import derived as D
from missive.sources.tables import dealt_tables

# the fixture has a few messages per channel and day; the worker's own limit is DS.CHANNEL_LIMIT
CHANNEL_LIMIT = 1

_CALLS = """(SELECT 'webhook_main' AS name, attempt_ts AS ts,
  NOT (http_status IS NULL OR http_status >= 500 OR http_status IN (429, 408)) AS ok,
  struct_pack(id := id, attempt_no := attempt_no, h := coalesce(http_status, -1), message_id := message_id,
    latency_s := latency_s) AS call_id FROM attempts)"""

_POISON = """CASE WHEN NOT json_valid(payload) THEN true WHEN json_type(payload) = 'NULL' THEN false
  WHEN json_type(payload) <> 'OBJECT' THEN true
  ELSE NOT (coalesce(json_type(payload, '$.id'), 'NULL') IN ('VARCHAR', 'NULL')
    AND coalesce(json_type(payload, '$.correlation_id'), 'NULL') IN ('VARCHAR', 'NULL')
    AND coalesce(json_type(payload, '$.recipient'), 'NULL') IN ('VARCHAR', 'NULL')
    AND coalesce(json_type(payload, '$.channel'), 'NULL') IN ('VARCHAR', 'NULL')
    AND coalesce(json_type(payload, '$.content'), 'NULL') IN ('VARCHAR', 'NULL')
    AND coalesce(json_type(payload, '$.priority'), 'NULL') IN ('VARCHAR', 'NULL')) END"""

_FINAL = f"""SELECT msg_id, nid, disposition FROM (WITH RECURSIVE
m1 AS (SELECT id AS msg_id, created_at AS ts, {_POISON} AS poison,
    CASE WHEN json_valid(payload) THEN coalesce(payload ->> '$.id', '') ELSE '' END AS nid,
    CASE WHEN json_valid(payload) THEN coalesce(payload ->> '$.channel', '') ELSE '' END AS channel FROM outbox),
m2 AS (SELECT m1.*, EXISTS (SELECT 1 FROM cancel_requests c WHERE c.id = m1.nid AND c.ts <= m1.ts
    AND m1.ts < c.ts + INTERVAL 24 HOUR) AS canceled FROM m1),
m3 AS (SELECT m2.*, NOT poison AND nid <> '' AND NOT canceled AS reach FROM m2),
m4 AS (SELECT m3.*, reach AND row_number() OVER (PARTITION BY nid, reach ORDER BY ts, msg_id) = 1 AS first,
    n.status, n.next_retry_at, n.retry_count FROM m3 LEFT JOIN notifications n ON n.id = m3.nid),
m5 AS (SELECT *, coalesce(first AND (status = 'pending' OR (status = 'failed_retrying' AND next_retry_at <= ts)),
    false) AS taken FROM m4),
lsrc AS (SELECT msg_id, channel, epoch_ms(ts) AS ms,
    row_number() OVER (PARTITION BY channel ORDER BY epoch_ms(ts), msg_id) AS rn FROM m5 WHERE taken),
lr AS (SELECT channel, rn, msg_id, true AS allowed, [ms] AS log FROM lsrc WHERE rn = 1
  UNION ALL
  SELECT channel, rn, msg_id, len(kept) < {CHANNEL_LIMIT},
    CASE WHEN len(kept) < {CHANNEL_LIMIT} THEN list_append(kept, ms) ELSE kept END
  FROM (SELECT s.channel, s.rn, s.msg_id, s.ms, list_filter(lr.log, lambda x: x > s.ms - {DS.CHANNEL_WINDOW_MS}) AS kept
        FROM lr JOIN lsrc s ON s.channel = lr.channel AND s.rn = lr.rn + 1)),
lat AS (SELECT id AS nid, CASE WHEN http_status IS NULL OR http_status >= 500 OR http_status IN (429, 408) THEN 'retriable'
      WHEN http_status BETWEEN 200 AND 299 THEN 'delivered' ELSE 'permanent' END AS outcome FROM attempts
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY attempt_ts DESC, attempt_no DESC,
      coalesce(http_status, -1) DESC, message_id DESC, latency_s DESC) = 1),
d AS (SELECT m5.*, lr.allowed, lat.outcome,
    EXISTS (SELECT 1 FROM rep WHERE rep.tripped AND rep.ts <= m5.ts
      AND m5.ts < rep.ts + INTERVAL {DS.BREAKER_OPEN_S} SECOND) AS breaker_open
  FROM m5 LEFT JOIN lr ON lr.msg_id = m5.msg_id LEFT JOIN lat ON lat.nid = m5.nid)
SELECT msg_id, nid, CASE WHEN poison THEN 'dlq_unparsable' WHEN nid = '' THEN 'skip_empty_id'
  WHEN canceled THEN 'skip_canceled'
  WHEN NOT taken AND status IS NULL THEN 'skip_missing'
  WHEN NOT taken AND status = 'failed_permanently' THEN 'dlq_again'
  WHEN NOT taken THEN 'skip_not_taken'
  WHEN NOT allowed THEN 'retry_limited'
  WHEN breaker_open OR outcome IS NULL OR outcome = 'retriable' THEN
    CASE WHEN retry_count + 1 < 3 THEN 'retry' ELSE 'dlq_permanent' END
  WHEN outcome = 'delivered' THEN 'delivered' ELSE 'dlq_permanent' END AS disposition FROM d)"""


@query("disposition", breaker_sql(_CALLS, DS.BREAKER_MAX, DS.BREAKER_WINDOW_S, DS.BREAKER_OPEN_S, final=_FINAL),
       ("outbox", "notifications", "attempts", "cancel_requests"))
def disposition(spark, sf, trips=None, channel_limit=CHANNEL_LIMIT, parsed=None, latest=None):
    """D4.  ``parsed``: the outbox as ``parsed_outbox`` gives it, ``latest``: the latest attempts,
    with ``trips``; where the caller has them at hand."""
    if parsed is not None:
        o = parsed.withColumnsRenamed({"id": "msg_id", "created_at": "ts"})
    else:
        with dealt_tables("orders"):          # a payload is written and parsed per row
            o = D.outbox(spark, sf).select(F.col("id").alias("msg_id"), F.col("created_at").alias("ts"), "payload")
    return DS.disposition(o, D.notifications(spark, sf), D.cancel_requests(spark, sf), D.attempts(spark, sf) if latest is None else latest,
                          channel_limit=channel_limit, trips=trips)


@query("dlq_split", breaker_sql(_CALLS, DS.BREAKER_MAX, DS.BREAKER_WINDOW_S, DS.BREAKER_OPEN_S,
                                final=f"""SELECT f.msg_id, f.disposition AS reason, CASE WHEN f.disposition <> 'dlq_unparsable' THEN f.nid END AS key, o.payload AS value
  FROM ({_FINAL}) f JOIN outbox o ON o.id = f.msg_id WHERE f.disposition LIKE 'dlq%'"""),
       ("outbox", "notifications", "attempts", "cancel_requests"))
def dlq_split(spark, sf):
    """What goes to the dead letter topic, from all three sites: the message's bytes under
    its notification id, unparsable ones without a key.  Written once, by topic, as the broker's
    (topic, key, value) bytes and read back."""
    with dealt_tables("orders"):
        messages = D.outbox(spark, sf).select(F.col("id").alias("msg_id"), "payload")
    path = DS.write_dead_letters(disposition(spark, sf), messages)
    return spark.read.parquet(path).where(F.col("topic") == DS.DLQ_TOPIC).select(
        "msg_id", "reason", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("webhook_calls", breaker_sql(_CALLS, DS.BREAKER_MAX, DS.BREAKER_WINDOW_S, DS.BREAKER_OPEN_S,
                                    final="""SELECT channel, CASE WHEN verdict = 'open' THEN 'circuit_open'
  WHEN h = -1 OR h >= 500 OR h IN (429, 408) THEN 'error' ELSE 'success' END AS result, count(*) AS value
FROM (SELECT verdict, struct_extract(call_id, 'h') AS h, struct_extract(call_id, 'id') AS id FROM rep)
JOIN notifications USING (id) GROUP BY ALL"""), ("attempts", "notifications"))
def webhook_calls(spark, sf, named=None):
    """A10: calls by channel and result; a call that the open breaker refuses is circuit_open."""
    rep = named if named is not None else named_calls(spark, sf).where("known")
    res = F.when(F.col("verdict") == "open", "circuit_open").when(~F.col("ok"), "error").otherwise("success")
    return A.counter(rep.withColumn("result", res), ["channel", "result"])


def named_calls(spark, sf):
    """Every webhook call replayed, with its latency and the channel and status of its notification
    (``known``: there is one)."""
    rep = DS.webhook_replay(D.attempts(spark, sf), keep=["ts", F.col("call_id.id").alias("id"), F.col("call_id.latency_s").alias("latency_s")])
    n = D.notifications(spark, sf).select("id", "channel", "status", F.lit(True).alias("known"))
    # a hash before the id: the join sorts, and compares numbers nearly every time
    j = rep.withColumn("_h", F.xxhash64("id")).join(n.withColumn("_h", F.xxhash64("id")), ["_h", "id"], "left")
    return j.select("name", "ts", "ok", "latency_s", "verdict", "tripped", "channel", "status", F.coalesce("known", F.lit(False)).alias("known"))


_DLQ_VIEWS = ("outbox", "notifications", "attempts", "cancel_requests")
DLQ_SQL = breaker_sql(_CALLS, DS.BREAKER_MAX, DS.BREAKER_WINDOW_S, DS.BREAKER_OPEN_S,
                      final=_FINAL.replace("SELECT msg_id, nid, disposition FROM (", "SELECT count(*) AS value FROM (", 1)
                      + " WHERE disposition LIKE 'dlq%'")


# the count is taken under the worker's own limit: the fixture's would hold nearly every message
# back before the rules that send it to the DLQ
@query("dlq_total", DLQ_SQL.replace(f"len(kept) < {CHANNEL_LIMIT}", f"len(kept) < {DS.CHANNEL_LIMIT}"), _DLQ_VIEWS)
def dlq_total(spark, sf):
    """Messages sent to the DLQ at any of its three sites: unparsable, failed for good
    on this message, or already failed for good when it came."""
    d = disposition(spark, sf, channel_limit=DS.CHANNEL_LIMIT)
    return d.where(F.col("disposition").startswith("dlq")).agg(F.count(F.lit(1)).alias("value"))


_D2_KEY = "'k-' || CAST((CASE WHEN seq % 50 = 49 THEN seq - 1 ELSE seq END) % 5000 AS VARCHAR)"


@query("batch_atomic_admission", f"""WITH RECURSIVE mem AS (SELECT batch_no, {_D2_KEY} AS k FROM requests),
bk AS (SELECT batch_no, list(DISTINCT k) AS ks, count(*) <> count(DISTINCT k) AS inner_dup,
    row_number() OVER (ORDER BY batch_no) AS rn FROM mem GROUP BY batch_no),
r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS batch_no, CAST(NULL AS BOOLEAN) AS admitted,
    CAST([] AS VARCHAR[]) AS taken
  UNION ALL
  SELECT b.rn, b.batch_no, NOT b.inner_dup AND NOT list_has_any(r.taken, b.ks),
    CASE WHEN NOT b.inner_dup AND NOT list_has_any(r.taken, b.ks) THEN list_concat(r.taken, b.ks) ELSE r.taken END
  FROM r JOIN bk b ON b.rn = r.rn + 1)
SELECT batch_no, admitted FROM r WHERE rn > 0""", ("requests",))
def batch_atomic_admission(spark, sf):
    """D2 over the request batches with a key rule that makes batches b and b+250 share
    keys (chains of conflicts), plus the in-batch duplicates of the fixture."""
    from missive.operators.admission import batch_atomic_admission as admit_batches
    r = D.requests(spark, sf)
    base = F.when(F.col("seq") % 50 == 49, F.col("seq") - 1).otherwise(F.col("seq"))
    mem = r.select("batch_no", F.concat(F.lit("k-"), (base % 5000).cast("string")).alias("key"),
                   F.col("batch_no").alias("batch_order"))
    return admit_batches(mem).select("batch_no", "admitted")
