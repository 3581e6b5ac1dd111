"""Listing and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.functions.timefmt import decode_cursor, encode_cursor, rfc3339_nano
from missive.operators import listing as L
from missive.operators import transitions as M
from missive.plans.oracle_views import rfc3339
from missive.plans.registry import query
from missive.sources import derived as D

_COLS = ", ".join(L.LIST_COLUMNS)
AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"
CURSOR = ("1998-01-01T00:00:00Z", "00000000-0000-4000-8000-000000030000")


def _cursor_text():
    import base64
    return base64.b64encode("|".join(CURSOR).encode()).decode()


@query("scan_notifications", f"SELECT {_COLS} FROM notifications", ("notifications",))
def scan_notifications(spark, sf):
    return L.scan_notifications(D.notifications(spark, sf))


@query("scan_outbox_fifo", """SELECT id, aggregate_id, event_type, payload, created_at FROM outbox
  WHERE status = 'pending' ORDER BY created_at, id LIMIT 100""", ("outbox",))
def scan_outbox_fifo(spark, sf):
    o = D.outbox(spark, sf)
    return (o.where(F.col("status") == "pending")
             .select("id", "aggregate_id", "event_type", "payload", "created_at")
             .orderBy("created_at", "id").limit(100))


@query("filter_status", "SELECT id, status FROM notifications WHERE status = 'pending'", ("notifications",))
def filter_status(spark, sf):
    return D.notifications(spark, sf).where(L.filter_status("pending")).select("id", "status")


@query("filter_channel", "SELECT id, channel FROM notifications WHERE channel = 'sms'", ("notifications",))
def filter_channel(spark, sf):
    return D.notifications(spark, sf).where(L.filter_channel("sms")).select("id", "channel")


@query("filter_date_range", """SELECT id, created_at FROM notifications
  WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1998-01-01'""", ("notifications",))
def filter_date_range(spark, sf):
    n = D.notifications(spark, sf)
    return n.where(L.filter_date_range("1996-01-01", "1997-12-31")).select("id", "created_at")


@query("filter_compose", """SELECT id, status, channel, created_at FROM notifications
  WHERE status = 'failed_retrying' AND channel = 'email'
    AND created_at >= TIMESTAMP '1996-03-01 12:00:00' AND created_at <= TIMESTAMP '1999-01-01 00:00:00'""",
       ("notifications",))
def filter_compose(spark, sf):
    n = D.notifications(spark, sf)
    pred = L.filter_compose("failed_retrying", "email", "1996-03-01T15:00:00+03:00", "1999-01-01T00:00:00Z")
    return n.where(pred).select("id", "status", "channel", "created_at")


@query("keyset_predicate", f"""SELECT id, created_at FROM notifications
  WHERE status = 'pending' AND (created_at, id) < (TIMESTAMP '1998-01-01 00:00:00', '{CURSOR[1]}')""",
       ("notifications",))
def keyset_predicate(spark, sf):
    import datetime as dt
    n = D.notifications(spark, sf)
    return (n.where(L.filter_status("pending") & L.keyset_predicate(dt.datetime(1998, 1, 1), CURSOR[1]))
             .select("id", "created_at"))


@query("list_page", f"""SELECT {_COLS} FROM notifications WHERE status = 'pending' AND channel = 'sms'
  ORDER BY created_at DESC, id DESC LIMIT 10""", ("notifications",))
def list_page(spark, sf):
    return L.list_page(D.notifications(spark, sf), status="pending", channel="sms", limit="10")


@query("list_page_after_cursor", f"""SELECT {_COLS} FROM notifications WHERE status = 'pending'
  AND (created_at, id) < (TIMESTAMP '1998-01-01 00:00:00', '{CURSOR[1]}')
  ORDER BY created_at DESC, id DESC LIMIT 25""", ("notifications",))
def list_page_after_cursor(spark, sf):
    return L.list_page(D.notifications(spark, sf), status="pending", cursor=_cursor_text(), limit=25)


_PAGE_SQL = f"""(SELECT * FROM notifications WHERE status = 'pending' AND channel = 'sms'
  ORDER BY created_at DESC, id DESC LIMIT 10)"""


@query("next_cursor", f"""SELECT 10 AS "limit",
  CASE WHEN count(*) = 10 THEN to_base64(encode({rfc3339('min(created_at)')} || '|' ||
    arg_min(id, (created_at, id)))) ELSE '' END AS next_cursor,
  count(*) = 10 AS has_more FROM {_PAGE_SQL}""", ("notifications",))
def next_cursor(spark, sf):
    page = L.list_page(D.notifications(spark, sf), status="pending", channel="sms", limit=10)
    return L.page_meta(page, 10)


@query("has_more", """SELECT status, channel, count(*) >= 10 AS has_more FROM notifications
  GROUP BY status, channel""", ("notifications",))
def has_more(spark, sf):
    n = D.notifications(spark, sf)
    return n.groupBy("status", "channel").agg((F.count(F.lit(1)) >= 10).alias("has_more"))


_CURSOR_TABLE = """SELECT id, CASE k % 7 WHEN 0 THEN 'invalid-base64!!!'
    WHEN 1 THEN to_base64(encode('no-pipe-here'))
    WHEN 2 THEN to_base64(encode({ts} || '|'))
    WHEN 3 THEN to_base64(encode('2026-03|' || id))
    ELSE to_base64(encode({ts} || '|' || id)) END AS cursor
  FROM (SELECT *, CAST(substr(id, 25, 12) AS BIGINT) AS k FROM notifications)"""


@query("cursor_decode", f"""WITH c AS ({_CURSOR_TABLE.format(ts=rfc3339('created_at'))})
SELECT id, ok, CASE WHEN ok THEN t END AS cursor_time, CASE WHEN ok THEN i END AS cursor_id FROM (
  SELECT id, t, i, t IS NOT NULL AND coalesce(i <> '', false) AS ok FROM (
    SELECT id, CASE WHEN n = 2 AND regexp_full_match(p[1], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]{{1,9}})?(Z|[+-][0-9]{{2}}:[0-9]{{2}})')
      THEN CAST(CAST(p[1] AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END AS t,
      CASE WHEN n = 2 THEN p[2] END AS i FROM (
      SELECT id, string_split(txt, '|') AS p, len(string_split(txt, '|')) AS n FROM (
        SELECT id, CASE WHEN regexp_full_match(cursor, '[A-Za-z0-9+/]*={{0,2}}') AND length(cursor) % 4 = 0
          THEN decode(from_base64(cursor)) END AS txt FROM c))))""", ("notifications",))
def cursor_decode(spark, sf):
    n = D.notifications(spark, sf)
    k = F.substring("id", 25, 12).cast("bigint")
    ts = rfc3339_nano("created_at")
    enc = lambda c: F.base64(F.encode(c, "UTF-8"))
    cur = (F.when(k % 7 == 0, F.lit("invalid-base64!!!"))
           .when(k % 7 == 1, enc(F.lit("no-pipe-here")))
           .when(k % 7 == 2, enc(F.concat(ts, F.lit("|"))))
           .when(k % 7 == 3, enc(F.concat(F.lit("2026-03|"), F.col("id"))))
           .otherwise(encode_cursor("created_at", "id")))
    d = n.select("id", decode_cursor(cur).alias("d"))
    return d.select("id", "d.ok", "d.cursor_time", "d.cursor_id")


_ENV_ROW = """'{{"id":"' || id || '"' || CASE WHEN batch_id IS NULL THEN '' ELSE ',"batch_id":"' || batch_id || '"' END ||
  CASE WHEN external_id IS NULL THEN '' ELSE ',"external_id":"' || external_id || '"' END ||
  ',"idempotency_key":"' || idempotency_key || '","recipient":"' || recipient || '","channel":"' || channel ||
  '","content":"' || content || '","priority":"' || priority || '","status":"' || status ||
  '","retry_count":' || CAST(retry_count AS VARCHAR) ||
  CASE WHEN next_retry_at IS NULL THEN '' ELSE ',"next_retry_at":"' || {nr} || '"' END ||
  ',"created_at":"' || {ca} || '","updated_at":"' || {ua} || '"}}'"""


@query("list_envelope", f"""SELECT '{{"data":[' || coalesce(string_agg(r, ',' ORDER BY created_at DESC, id DESC), '') ||
  '],"meta":{{"has_more":' || CASE WHEN count(*) = 10 THEN 'true' ELSE 'false' END || ',"limit":10,"next_cursor":"' ||
  CASE WHEN count(*) = 10 THEN to_base64(encode({rfc3339('min(created_at)')} || '|' || arg_min(id, (created_at, id)))) ELSE '' END
  || '"}}}}' AS envelope
FROM (SELECT *, {_ENV_ROW.format(nr=rfc3339('next_retry_at'), ca=rfc3339('created_at'), ua=rfc3339('updated_at'))} AS r
  FROM {_PAGE_SQL})""", ("notifications",))
def list_envelope(spark, sf):
    page = L.list_page(D.notifications(spark, sf), status="pending", channel="sms", limit=10)
    return L.list_envelope(page, 10)


@query("batch_listing", """SELECT batch_id, id, status, created_at,
  row_number() OVER (PARTITION BY batch_id ORDER BY created_at DESC, id DESC) AS pos FROM notifications""",
       ("notifications",))
def batch_listing(spark, sf):
    return L.batch_listing(D.notifications(spark, sf))


@query("batch_status", """SELECT batch_id, count(*) AS total_count,
  CAST(count_if(status = 'pending') AS BIGINT) AS n_pending, CAST(count_if(status = 'processing') AS BIGINT) AS n_processing,
  CAST(count_if(status = 'delivered') AS BIGINT) AS n_delivered, CAST(count_if(status = 'failed_retrying') AS BIGINT) AS n_failed_retrying,
  CAST(count_if(status = 'failed_permanently') AS BIGINT) AS n_failed_permanently, CAST(count_if(status = 'canceled') AS BIGINT) AS n_canceled
FROM notifications GROUP BY batch_id""", ("notifications",))
def batch_status(spark, sf):
    return L.batch_status(D.notifications(spark, sf))


@query("sweep_limit", f"""SELECT id, next_retry_at, retry_count FROM notifications
  WHERE status = 'failed_retrying' AND next_retry_at <= {AS_OF_SQL}
  ORDER BY next_retry_at, id LIMIT 1000""", ("notifications",))
def sweep_limit(spark, sf):
    return L.sweep_limit(D.notifications(spark, sf), D.AS_OF)


@query("top_per_group", """SELECT * FROM (SELECT id, topic, created_at,
  row_number() OVER (PARTITION BY topic ORDER BY created_at, id) AS rank FROM (
  SELECT id, created_at, CASE priority WHEN 'high' THEN 'notifications-high' WHEN 'low' THEN 'notifications-low'
    ELSE 'notifications-normal' END AS topic FROM notifications WHERE status = 'pending'))
  WHERE rank <= 5""", ("notifications",))
def top_per_group(spark, sf):
    from missive.operators.projections import route_priority
    n = D.notifications(spark, sf).where(F.col("status") == "pending")
    n = n.select("id", "created_at", route_priority("priority").alias("topic"))
    return L.top_per_group(n, "topic", [F.col("created_at"), F.col("id")], 5)


@query("get_by_id", f"""SELECT {_COLS} FROM notifications n
  WHERE EXISTS (SELECT 1 FROM attempts a WHERE a.id = n.id AND a.http_status = 500)""",
       ("notifications", "attempts"))
def get_by_id(spark, sf):
    ids = D.attempts(spark, sf).where(F.col("http_status") == 500).select("id")
    return L.scan_notifications(M.lookup_ids(D.notifications(spark, sf), ids))


@query("date_range_check", """SELECT k, start_text, end_text,
  CAST(start_text AS TIMESTAMP) < CAST(end_text AS TIMESTAMP) + INTERVAL 1 DAY AS range_ok
FROM (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS start_text,
  strftime(o_orderdate + to_days(CAST(o_orderkey % 5 - 2 AS INT)), '%Y-%m-%d') AS end_text FROM orders)""")
def date_range_check(spark, sf):
    return L.saved_search_check(spark, sf)


@query("lock_eligible", f"""SELECT id, status FROM notifications WHERE status = 'pending'
  OR (status = 'failed_retrying' AND next_retry_at <= {AS_OF_SQL})""", ("notifications",))
def lock_eligible(spark, sf):
    return D.notifications(spark, sf).where(M.lock_eligible(D.AS_OF)).select("id", "status")


@query("cancel_eligible", """SELECT id, status FROM notifications WHERE status IN ('pending', 'failed_retrying')""",
       ("notifications",))
def cancel_eligible(spark, sf):
    return D.notifications(spark, sf).where(M.cancel_eligible()).select("id", "status")


@query("retry_due", f"""SELECT id, next_retry_at FROM notifications
  WHERE status = 'failed_retrying' AND next_retry_at <= {AS_OF_SQL}""", ("notifications",))
def retry_due(spark, sf):
    n = D.notifications(spark, sf)
    return n.where(L.retry_due(n, D.AS_OF)).select("id", "next_retry_at")


@query("zombie_rows", f"""SELECT id, updated_at, retry_count FROM notifications
  WHERE status = 'processing' AND updated_at < {AS_OF_SQL} - INTERVAL 5 MINUTE""", ("notifications",))
def zombie_rows(spark, sf):
    return D.notifications(spark, sf).where(M.zombie(D.AS_OF)).select("id", "updated_at", "retry_count")
