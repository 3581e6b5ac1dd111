"""Join, de-duplication and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.operators import joins as J
from missive.operators import listing as L
from missive.operators import transitions as M
from missive.operators import validate as V
from missive.plans.registry import query
from missive.plans.validation import _FIRST_ERROR, _NORM
from missive.sources import derived as D

AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"

# Oracle text of the admitted requests: valid, first arrival of the key, key not taken.
ADMITTED_SQL = f"""(SELECT * FROM (SELECT *, min(seq) OVER (PARTITION BY idempotency_key) AS first_seq FROM (
    SELECT seq, arrival_ts, idempotency_key, recipient, channel, content,
      CASE WHEN priority = '' THEN 'normal' ELSE priority END AS priority, {_FIRST_ERROR} AS error
    FROM ({_NORM.replace("SELECT seq, batch_no,", "SELECT seq, batch_no, arrival_ts,")})) WHERE error IS NULL)
  WHERE seq = first_seq AND idempotency_key NOT IN (SELECT idempotency_key FROM notifications))"""


def admitted(spark, sf):
    """Valid requests that are the first valid one of their key, key not yet taken."""
    v = V.validate_requests(D.requests(spark, sf))
    # an invalid request never reaches the insert, so it takes no key: first among valid
    # (a conditional min, so the validation runs once, inside the aggregate's projection)
    first = (v.groupBy("idempotency_key").agg(F.min(F.when(F.col("error").isNull(), F.col("seq"))).alias("seq"))
              .where(F.col("seq").isNotNull()))
    ok = v.join(first, ["idempotency_key", "seq"], "left_semi").drop("error")
    return J.dedup_against_existing(ok, D.notifications(spark, sf))


@query("cancel_flag_join", """SELECT msg_id, id, ts FROM messages m WHERE NOT EXISTS (
  SELECT 1 FROM cancels c WHERE c.id = m.id AND c.cancel_ts <= m.ts AND m.ts < c.cancel_ts + INTERVAL 24 HOUR)""",
       ("messages", "cancels"))
def cancel_flag_join(spark, sf):
    return J.cancel_flag_join(D.messages(spark, sf), D.cancels(spark, sf))


@query("dedup_against_existing", f"""SELECT seq, idempotency_key FROM (
  SELECT seq, idempotency_key, {_FIRST_ERROR} AS error FROM ({_NORM})) v
  WHERE error IS NULL AND NOT EXISTS (SELECT 1 FROM notifications n WHERE n.idempotency_key = v.idempotency_key)""",
       ("requests", "notifications"))
def dedup_against_existing(spark, sf):
    ok, _ = V.validity_split(D.requests(spark, sf))
    return J.dedup_against_existing(ok, D.notifications(spark, sf)).select("seq", "idempotency_key")


@query("sweep_semi_join", f"""WITH sel AS (SELECT id FROM notifications WHERE status = 'failed_retrying'
  AND next_retry_at <= {AS_OF_SQL} ORDER BY next_retry_at, id LIMIT 1000)
SELECT id, CASE WHEN id IN (SELECT id FROM sel) THEN 'pending' ELSE status END AS status FROM notifications""",
       ("notifications",))
def sweep_semi_join(spark, sf):
    n = D.notifications(spark, sf)
    sel = L.sweep_limit(n, D.AS_OF).select("id", F.lit(True).alias("_sel"))
    j = n.join(sel, "id", "left")
    return j.select("id", F.when(F.col("_sel"), F.lit("pending")).otherwise(F.col("status")).alias("status"))


@query("status_lookup", """SELECT req_id, r.id, coalesce(n.status, 'missing') AS status
  FROM cancel_requests r LEFT JOIN notifications n ON n.id = r.id""", ("cancel_requests", "notifications"))
def status_lookup(spark, sf):
    return J.status_lookup(D.cancel_requests(spark, sf).select("req_id", "id"),
                           D.notifications(spark, sf)).select("req_id", "id", "status")


@query("outbox_remove_sent", """SELECT id FROM outbox o WHERE status = 'pending'
  AND id NOT IN (SELECT id FROM outbox WHERE aggregate_id IN (SELECT id FROM attempts WHERE http_status = 200))""",
       ("outbox", "attempts"))
def outbox_remove_sent(spark, sf):
    o = D.outbox(spark, sf)
    sent = o.join(D.attempts(spark, sf).where(F.col("http_status") == 200)
                  .select(F.col("id").alias("aggregate_id")), "aggregate_id", "left_semi")
    return J.remove_sent(o.where(F.col("status") == "pending"), sent).select("id")


@query("outbox_minus_sent", """SELECT id FROM outbox WHERE status = 'pending'
  EXCEPT ALL SELECT id FROM outbox WHERE aggregate_id IN (SELECT id FROM attempts WHERE http_status = 200)""",
       ("outbox", "attempts"))
def outbox_minus_sent(spark, sf):
    """U2 in its set form: ``exceptAll`` on the id column."""
    o = D.outbox(spark, sf)
    sent = o.join(D.attempts(spark, sf).where(F.col("http_status") == 200)
                  .select(F.col("id").alias("aggregate_id")), "aggregate_id", "left_semi")
    return o.where(F.col("status") == "pending").select("id").exceptAll(sent.select("id"))


@query("outbox_for_batch", """SELECT n.batch_id, o.id, o.event_type FROM outbox o
  JOIN notifications n ON o.aggregate_id = n.id WHERE n.batch_id IS NOT NULL""", ("outbox", "notifications"))
def outbox_for_batch(spark, sf):
    n = D.notifications(spark, sf).where(F.col("batch_id").isNotNull()).select(
        F.col("id").alias("aggregate_id"), "batch_id")
    return D.outbox(spark, sf).join(n, "aggregate_id").select("batch_id", "id", "event_type")


_LATEST = """(SELECT id, http_status, message_id, attempt_ts AS at_ts FROM attempts
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY attempt_ts DESC, attempt_no DESC,
      coalesce(http_status, -1) DESC, message_id DESC, latency_s DESC) = 1)"""

OUTCOME_SQL = f"""SELECT id, status0 AS old_status,
  CASE WHEN proc AND oc = 'delivered' THEN 'delivered'
       WHEN proc AND oc = 'retriable' AND retry_count + 1 < 3 THEN 'failed_retrying'
       WHEN proc THEN 'failed_permanently' ELSE status0 END AS status,
  CAST(CASE WHEN proc AND oc <> 'delivered' THEN retry_count + 1 ELSE retry_count END AS INT) AS retry_count,
  CASE WHEN proc AND oc = 'retriable' AND retry_count + 1 < 3 THEN at_ts + to_minutes(CAST(power(2, retry_count) AS BIGINT))
       WHEN proc AND oc <> 'delivered' THEN NULL ELSE next_retry_at END AS next_retry_at,
  CASE WHEN proc AND oc = 'delivered' THEN nullif(message_id, '') ELSE external_id END AS external_id,
  CASE WHEN proc THEN at_ts ELSE updated_at END AS updated_at,
  coalesce(proc AND (oc = 'permanent' OR (oc = 'retriable' AND retry_count + 1 >= 3)), false) AS dlq
FROM (SELECT n.id, n.status AS status0, n.retry_count, n.next_retry_at, n.external_id, n.updated_at,
    a.message_id, a.at_ts, coalesce(n.status = 'processing' AND a.id IS NOT NULL, false) AS proc,
    CASE WHEN a.id IS NULL THEN NULL WHEN a.http_status IS NULL OR a.http_status >= 500 OR a.http_status IN (429, 408)
      THEN 'retriable' WHEN a.http_status BETWEEN 200 AND 299 THEN 'delivered' ELSE 'permanent' END AS oc
  FROM notifications n LEFT JOIN {_LATEST} a ON a.id = n.id)"""


@query("outcome_apply_join", OUTCOME_SQL, ("notifications", "attempts"))
def outcome_apply_join(spark, sf):
    n = D.notifications(spark, sf).withColumn("old_status", F.col("status"))
    out = M.apply_outcomes(n, D.attempts(spark, sf), keep=("old_status",))
    return out.select("id", "old_status", "status", "retry_count", "next_retry_at",
                      "external_id", "updated_at", "dlq")


@query("dedup_in_batch", """SELECT seq, batch_no, idempotency_key, first_seq, seq > first_seq AS is_dup,
  max(n_in_batch) OVER (PARTITION BY batch_no) > 1 AS batch_has_dup FROM (
  SELECT seq, batch_no, idempotency_key, min(seq) OVER (PARTITION BY idempotency_key) AS first_seq,
    count(*) OVER (PARTITION BY batch_no, idempotency_key) AS n_in_batch FROM requests)""", ("requests",))
def dedup_in_batch(spark, sf):
    return J.dedup_in_batch(D.requests(spark, sf))


@query("relay_poison_filter", "SELECT id, __POISON__ AS poison FROM outbox", ("outbox",))
def relay_poison_filter(spark, sf):
    o = D.outbox(spark, sf)
    return o.select("id", J.poison_payload(F.col("payload")).alias("poison"))


@query("outbox_append", f"""SELECT 'o-' || '30000000-0000-4000-8000-' || lpad(CAST(seq AS VARCHAR), 12, '0') AS id,
    'NotificationCreated' AS event_type FROM {ADMITTED_SQL}
  UNION ALL SELECT 'r-' || id, 'NotificationRetry' FROM notifications
    WHERE status = 'failed_retrying' AND next_retry_at <= {AS_OF_SQL}
  UNION ALL SELECT 'z-' || id, 'NotificationCreated' FROM notifications
    WHERE status = 'processing' AND updated_at < {AS_OF_SQL} - INTERVAL 5 MINUTE AND retry_count < 3""",
       ("requests", "notifications"))
def outbox_append(spark, sf):
    n = D.notifications(spark, sf)
    _, created = M.apply_create(admitted(spark, sf))
    _, retry = M.sweep_retries(n, D.AS_OF)
    _, zomb = M.sweep_zombies(n, D.AS_OF)
    return created.unionByName(retry).unionByName(zomb).select("id", "event_type")


@query("sweep_snapshot", f"""SELECT id, CASE WHEN status = 'failed_retrying' AND next_retry_at <= {AS_OF_SQL}
  THEN 'pending' ELSE status END AS status FROM notifications""", ("notifications",))
def sweep_snapshot(spark, sf):
    new, _ = M.sweep_retries(D.notifications(spark, sf), D.AS_OF)
    return new.select("id", "status")
