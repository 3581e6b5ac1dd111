"""The derived inputs of ``missive.sources.derived`` restated as DuckDB SQL views.

Used only by the correctness oracle: each oracle query is ``WITH <views> <query>``.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["requests"] = """
SELECT event_id AS seq, ts AS arrival_ts,
  CAST(floor(event_id / 20) AS BIGINT) AS batch_no,
  'k-' || CAST(CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS idempotency_key,
  CASE WHEN event_id % 41 = 0 THEN ''
       WHEN event_type = 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'abc'
            ELSE '+90555' || lpad(CAST(user_id AS VARCHAR), 7, '0') END
       WHEN event_type IN ('click', 'view') THEN 'device-' || CAST(user_id AS VARCHAR)
       ELSE CASE WHEN event_id % 13 = 0 THEN 'not-an-email'
            ELSE 'user_' || CAST(user_id AS VARCHAR) || '@example.com' END END AS recipient,
  CASE WHEN event_type = 'error' THEN ' SMS ' WHEN event_type = 'click' THEN 'push'
       WHEN event_type = 'view' THEN 'Push' WHEN event_type = 'signup' THEN 'email'
       ELSE CASE WHEN event_id % 3 = 0 THEN 'fax' ELSE 'EMAIL' END END AS channel,
  repeat('x', CAST(floor(value * 2) AS INT)) AS content,
  CASE event_id % 5 WHEN 0 THEN ' HIGH ' WHEN 1 THEN 'normal' WHEN 2 THEN 'low' WHEN 3 THEN ''
       ELSE CASE WHEN event_id % 25 = 4 THEN 'critical' ELSE 'high' END END AS priority,
  '10.0.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id AS VARCHAR) || ', 10.9.9.9' AS xff,
  CASE WHEN event_id % 3 = 0 THEN 'req-' || CAST(event_id AS VARCHAR) END AS correlation_id
FROM events"""

_HEAD = """'"idempotency_key":"' || idempotency_key || '","recipient":"' || recipient ||
  '","channel":"' || channel || '","content":"' || content || '"'"""

VIEWS["request_json"] = f"""
SELECT seq, batch_no, arrival_ts,
  CASE WHEN seq % 9973 IN (4000, 4001) THEN '{{"content":"' || repeat('y', 600000) || '",' || {_HEAD} || '}}'
       WHEN seq % 29 = 5 THEN '{{"Channel":"fax",' || {_HEAD} || '}}'
       WHEN seq % 29 = 6 THEN '{{' || {_HEAD} || ',"CHANNEL":"sms"}}'
       WHEN seq % 37 = 0 THEN ''
       WHEN seq % 31 = 0 THEN '{{"idempotency_key":"' || idempotency_key || '","recipient":'
       WHEN seq % 23 = 0 THEN '{{' || {_HEAD} || ',"priority":5}}'
       WHEN seq % 11 = 0 THEN '{{' || {_HEAD} || ',"priority":"' || priority || '","extra":"1"}}'
       WHEN seq % 7 = 3 THEN '{{' || {_HEAD} || '}}'
       WHEN seq % 43 = 0 THEN '{{' || {_HEAD} || ',"priority":null}}'
       ELSE '{{' || {_HEAD} || ',"priority":"' || priority || '"}}' END AS body, xff
FROM requests"""

VIEWS["batch_json"] = """
SELECT batch_no, min(arrival_ts) AS arrival_ts,
  CASE WHEN batch_no % 13 = 0 THEN '[]'
       ELSE '[' || string_agg(body, ',' ORDER BY seq) || ']' END AS body, arg_min(xff, seq) AS xff
FROM (SELECT seq, batch_no, arrival_ts, xff, CASE WHEN batch_no % 3 = 0 THEN
    '{"idempotency_key":"g-' || CASE WHEN batch_no % 9 = 6 THEN seq - 60 WHEN seq % 50 = 49 THEN seq - 1 ELSE seq END ||
    '","recipient":"user_' || seq || '@example.com","channel":"' || CASE WHEN batch_no % 15 = 12 AND seq % 20 = 7 THEN 'fax' ELSE 'email' END ||
    '","content":"batch ' || batch_no || '","priority":"high"}' ELSE body END AS body
  FROM request_json WHERE batch_no % 3 = 0 OR (body <> '' AND seq % 31 <> 0)) GROUP BY batch_no"""

VIEWS["notifications"] = """
SELECT '00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id,
  '10000000-0000-4000-8000-' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS batch_id,
  'k-' || CAST(o_orderkey * 3 AS VARCHAR) AS idempotency_key,
  'user_' || CAST(o_custkey AS VARCHAR) || '@example.com' AS recipient,
  CASE o_orderkey % 3 WHEN 0 THEN 'sms' WHEN 1 THEN 'email' ELSE 'push' END AS channel,
  'order ' || CAST(o_orderkey AS VARCHAR) AS content,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
       WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'normal' END AS priority,
  st AS status,
  CASE WHEN st = 'delivered' THEN 'ext-' || CAST(o_orderkey AS VARCHAR) END AS external_id,
  CAST(o_orderkey % 4 AS INT) AS retry_count,
  CASE WHEN st = 'failed_retrying' THEN o_orderdate + INTERVAL 2 DAY END AS next_retry_at,
  CASE WHEN o_orderkey % 2 = 0 THEN 'c-' || CAST(o_orderkey AS VARCHAR) END AS correlation_id,
  o_orderdate AS created_at, o_orderdate AS updated_at
FROM (SELECT *, CASE (o_orderkey * 7 + o_custkey) % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing'
  WHEN 2 THEN 'delivered' WHEN 3 THEN 'failed_retrying' WHEN 4 THEN 'failed_permanently'
  ELSE 'canceled' END AS st FROM orders)"""

VIEWS["attempts"] = """
SELECT '00000000-0000-4000-8000-' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS id,
  l_linenumber AS attempt_no, l_shipdate AS attempt_ts,
  CAST(CASE WHEN l_suppkey % 97 = 0 THEN NULL
       ELSE CASE l_returnflag || l_linestatus WHEN 'AF' THEN 200 WHEN 'AO' THEN 202
            WHEN 'NF' THEN 500 WHEN 'NO' THEN 429 WHEN 'RF' THEN 400 WHEN 'RO' THEN 408 END END AS INT)
    AS http_status,
  CASE WHEN l_linenumber % 2 = 1 THEN 'm-' || CAST(l_orderkey AS VARCHAR) || '-' ||
       CAST(l_linenumber AS VARCHAR) ELSE '' END AS message_id,
  l_quantity / 10.0 AS latency_s
FROM lineitem"""

VIEWS["offset_log"] = """
SELECT CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS topic,
  CAST(floor(event_id / 3) % 3 AS INT) AS "partition",
  CAST(floor(event_id / 9) AS BIGINT) AS "offset",
  ts AS tracked_at,
  CAST(CASE WHEN event_id % 997 <> 0 THEN event_id + floor(value) END AS BIGINT) AS done_rank,
  CASE WHEN event_id % 997 <> 0 THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) END AS done_at,
  CASE WHEN event_id % 499 <> 0 THEN ts + to_seconds(CAST(floor(value / 4) AS BIGINT)) END AS picked_at
FROM events"""

VIEWS["calls"] = """
SELECT event_id AS call_id, 'hook_' || CAST(user_id % 4 AS VARCHAR) AS name, ts,
  event_type <> 'error' AS ok FROM events"""

VIEWS["messages"] = """
SELECT event_id AS msg_id, user_id AS id, ts FROM events WHERE event_type <> 'signup'"""

VIEWS["cancels"] = """
SELECT user_id AS id, ts AS cancel_ts FROM events WHERE event_type = 'signup'"""

VIEWS["transitions"] = """
SELECT conv_id AS id, turn AS seq,
  CASE (conv_id + turn) % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing'
    WHEN 2 THEN 'failed_retrying' WHEN 3 THEN 'pending' WHEN 4 THEN 'delivered'
    ELSE 'failed_permanently' END AS status,
  CAST(turn AS INT) AS retry_count
FROM conversations"""

VIEWS["api_log"] = """
SELECT CASE WHEN event_type = 'view' THEN 'GET' WHEN event_type = 'error' THEN 'DELETE'
            ELSE 'POST' END AS method,
  CASE WHEN event_type = 'view' THEN '/notifications'
       WHEN event_type = 'error' THEN '/notifications/{id}'
       WHEN event_type = 'purchase' THEN '/notifications/batch'
       ELSE '/notifications' END AS route,
  CASE WHEN event_id % 17 = 0 THEN '429' WHEN event_id % 19 = 0 THEN '409' ELSE '202' END
    AS status_code,
  value / 100.0 AS latency_s, ts
FROM events"""

VIEWS["doc_requests"] = """
SELECT doc_id AS seq, 'd-' || CAST(doc_id AS VARCHAR) AS idempotency_key,
  CASE doc_id % 3 WHEN 0 THEN '+90555' || lpad(CAST(doc_id AS VARCHAR), 7, '0')
       WHEN 1 THEN 'doc' || CAST(doc_id AS VARCHAR) || '@example.com'
       ELSE 'device-' || CAST(doc_id AS VARCHAR) END AS recipient,
  CASE doc_id % 3 WHEN 0 THEN 'sms' WHEN 1 THEN 'email' ELSE 'push' END AS channel,
  text AS content, 'normal' AS priority
FROM documents"""

VIEWS["limiter_requests"] = """
SELECT event_id AS req_id, event_type AS key, ts, CAST(1 + event_id % 5 AS INT) AS weight
FROM events"""

# Views other views depend on, in dependency order.
_DEPS = {"request_json": ["requests"], "batch_json": ["requests", "request_json"]}


# A payload is poison unless it is JSON null or an object whose six fields are strings or null.
POISON = "(CASE WHEN NOT json_valid(payload) THEN true WHEN json_type(payload) = 'NULL' THEN false\n" \
    "  WHEN json_type(payload) <> 'OBJECT' THEN true ELSE NOT (" + " AND ".join(
        f"coalesce(json_type(payload, '$.{f}'), 'NULL') IN ('VARCHAR', 'NULL')"
        for f in ("id", "correlation_id", "recipient", "channel", "content", "priority")) + ") END)"


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies first, each once)."""
    sql = sql.replace("__POISON__", POISON)
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

VIEWS["outbox"] = """
SELECT '20000000-0000-4000-8000-' || lpad(CAST(k AS VARCHAR), 12, '0') AS id, id AS aggregate_id,
  CASE WHEN status = 'failed_retrying' THEN 'NotificationRetry' ELSE 'NotificationCreated' END AS event_type,
  CASE WHEN k % 101 = 0 THEN '{"' || ['id', 'correlation_id', 'recipient', 'channel', 'content', 'priority'][k % 6 + 1] || '":5}'
       WHEN k % 103 = 0 THEN 'not json' WHEN k % 107 = 0 THEN 'null'
       WHEN k % 109 = 0 THEN '{"id":"90000000-0000-4000-8000-' || lpad(CAST(k AS VARCHAR), 12, '0') || '","channel":"sms"}'
       ELSE '{"id":"' || id || '","correlation_id":' ||
         CASE WHEN correlation_id IS NULL THEN 'null' ELSE '"' || correlation_id || '"' END ||
         ',"recipient":"' || recipient || '","channel":"' || channel || '","content":"' || content ||
         '","priority":"' || priority || '"}' || CASE WHEN k % 113 = 0 THEN ' junk' ELSE '' END END AS payload,
  CASE WHEN status IN ('pending', 'failed_retrying') THEN 'pending' ELSE 'sent' END AS status,
  created_at
FROM (SELECT *, CAST(substr(id, 25, 12) AS BIGINT) AS k FROM notifications)"""
_DEPS["outbox"] = ["notifications"]

# RFC3339Nano text of a UTC wall-clock timestamp (DuckDB).
def rfc3339(expr: str) -> str:
    return (f"(strftime({expr}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({expr}) % 1000000 = 0 THEN '' "
            f"ELSE '.' || rtrim(lpad(CAST(epoch_us({expr}) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z')")

VIEWS["cancel_requests"] = """
SELECT event_id AS req_id, '00000000-0000-4000-8000-' || lpad(CAST(event_id // 2 * 2 AS VARCHAR), 12, '0') AS id, ts
FROM events
UNION ALL SELECT 1000000000000000 + o_orderkey, '00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'),
  CAST(o_orderdate AS TIMESTAMP) - INTERVAL 3 HOUR FROM orders WHERE o_orderkey % 23 = 0"""

VIEWS["timed_calls"] = """
SELECT event_id AS call_id, 'hook_' || CAST(user_id % 4 AS VARCHAR) AS name, ts, event_type <> 'error' AS ok,
  ts + to_seconds(CAST(floor(value) AS BIGINT)) AS end_ts
FROM events"""
