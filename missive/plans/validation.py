"""Validation, ingestion and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.functions import text as T
from missive.operators import validate as V
from missive.operators import ingest, projections
from missive.plans.registry import query, sql_trim
from missive.sources import derived as D

_NORM = f"""
  SELECT seq, batch_no,
    {sql_trim("idempotency_key")} AS idempotency_key,
    {sql_trim("recipient")} AS recipient,
    lower({sql_trim("channel")}) AS channel,
    {sql_trim("content")} AS content,
    lower({sql_trim("priority")}) AS priority
  FROM requests"""

_FIRST_ERROR = """
  CASE WHEN recipient = '' THEN 'recipient_required'
       WHEN content = '' THEN 'content_required'
       WHEN strlen(content) > 2048 THEN 'content_too_large'
       WHEN idempotency_key = '' THEN 'key_required'
       WHEN strlen(idempotency_key) > 255 THEN 'key_too_long'
       WHEN channel = 'sms' AND strlen(content) > 160 THEN 'sms_too_long'
       WHEN channel = 'sms' AND NOT regexp_full_match(recipient, '\\+?[1-9][0-9]{7,14}') THEN 'sms_phone_format'
       WHEN channel = 'email' AND strlen(content) > 2048 THEN 'email_too_long'
       WHEN channel = 'email' AND NOT contains(recipient, '@') THEN 'email_address_format'
       WHEN channel = 'push' AND strlen(content) > 512 THEN 'push_too_long'
       WHEN channel NOT IN ('sms', 'email', 'push') THEN 'invalid_channel'
       WHEN priority NOT IN ('', 'low', 'normal', 'high') THEN 'invalid_priority'
  END"""


@query("normalize_request", f"SELECT seq, idempotency_key, recipient, channel, content, priority FROM ({_NORM})",
       ("requests",))
def normalize_request(spark, sf):
    return T.normalize_request(D.requests(spark, sf)).select(
        "seq", "idempotency_key", "recipient", "channel", "content", "priority")


@query("required_fields", f"""SELECT seq, recipient = '' AS recipient_missing, content = '' AS content_missing,
  idempotency_key = '' AS key_missing FROM ({_NORM})""", ("requests",))
def required_fields(spark, sf):
    return V.required_fields(D.requests(spark, sf))


@query("content_byte_limit", f"""SELECT seq, CAST(strlen(c) AS INT) AS content_bytes, CAST(length(c) AS INT) AS content_chars,
  strlen(c) > 2048 AS content_over, strlen(k) > 255 AS key_over
  FROM (SELECT seq, {sql_trim("content")} AS c, {sql_trim("idempotency_key")} AS k FROM doc_requests)""",
       ("doc_requests",))
def content_byte_limit(spark, sf):
    return V.content_byte_limit(D.doc_requests(spark, sf))


@query("channel_rules", f"""SELECT seq, channel,
  CASE WHEN channel = 'sms' THEN CASE WHEN strlen(content) > 160 THEN 'sms_too_long'
            WHEN NOT regexp_full_match(recipient, '\\+?[1-9][0-9]{{7,14}}') THEN 'sms_phone_format' END
       WHEN channel = 'email' THEN CASE WHEN strlen(content) > 2048 THEN 'email_too_long'
            WHEN NOT contains(recipient, '@') THEN 'email_address_format' END
       WHEN channel = 'push' THEN CASE WHEN strlen(content) > 512 THEN 'push_too_long' END
       ELSE 'invalid_channel' END AS channel_error
  FROM ({_NORM})""", ("requests",))
def channel_rules(spark, sf):
    return V.channel_rules(D.requests(spark, sf))


@query("priority_default", f"""SELECT seq,
  CASE WHEN priority = '' THEN 'normal' WHEN priority IN ('low', 'normal', 'high') THEN priority END AS priority,
  priority NOT IN ('', 'low', 'normal', 'high') AS priority_invalid FROM ({_NORM})""", ("requests",))
def priority_default(spark, sf):
    return V.priority_default(D.requests(spark, sf))


@query("validate_first_error", f"""SELECT seq, idempotency_key, recipient, channel, content,
  CASE WHEN priority = '' THEN 'normal' ELSE priority END AS priority, {_FIRST_ERROR} AS error
  FROM ({_NORM})""", ("requests",))
def validate_first_error(spark, sf):
    return V.validate_requests(D.requests(spark, sf)).select(
        "seq", "idempotency_key", "recipient", "channel", "content", "priority", "error")


@query("validate_documents", f"""SELECT seq, {_FIRST_ERROR} AS error FROM (
  SELECT seq, {sql_trim("idempotency_key")} AS idempotency_key, {sql_trim("recipient")} AS recipient,
    lower({sql_trim("channel")}) AS channel, {sql_trim("content")} AS content,
    lower({sql_trim("priority")}) AS priority FROM doc_requests)""", ("doc_requests",))
def validate_documents(spark, sf):
    """P6 over whole document texts (multi-byte, up to 20,000 words)."""
    return V.validate_requests(D.doc_requests(spark, sf)).select("seq", "error")


@query("validity_split", f"""SELECT error IS NULL AS valid, coalesce(error, '') AS reason, count(*) AS n
  FROM (SELECT {_FIRST_ERROR} AS error FROM ({_NORM})) GROUP BY ALL""", ("requests",))
def validity_split(spark, sf):
    ok, bad = V.validity_split(D.requests(spark, sf))
    both = (ok.select(F.lit(True).alias("valid"), F.lit("").alias("reason"))
            .unionByName(bad.select(F.lit(False).alias("valid"), F.col("error").alias("reason"))))
    return both.groupBy("valid", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("batch_first_invalid", f"""SELECT batch_no, min(row_no) AS row_no,
  arg_min(error, row_no) AS error FROM (
    SELECT batch_no, row_number() OVER (PARTITION BY batch_no ORDER BY seq) AS row_no,
      {_FIRST_ERROR} AS error FROM ({_NORM}))
  WHERE error IS NOT NULL GROUP BY batch_no""", ("requests",))
def batch_first_invalid(spark, sf):
    return V.batch_first_invalid(D.requests(spark, sf))


# ------------------------------------------------------------------------- ingestion
DECODED_SQL = """SELECT seq, error,
  CASE WHEN error IS NULL THEN k0 ELSE '' END AS idempotency_key,
  CASE WHEN error IS NULL THEN k1 ELSE '' END AS recipient,
  CASE WHEN error IS NULL THEN k2 ELSE '' END AS channel,
  CASE WHEN error IS NULL THEN k3 ELSE '' END AS content,
  CASE WHEN error IS NULL THEN k4 ELSE '' END AS priority FROM (SELECT seq,
  CASE WHEN octet_length(encode(body)) > 524288 THEN 'body_too_large' WHEN body = '' THEN 'empty_body'
       WHEN NOT json_valid(body) THEN 'malformed_json'
       WHEN json_type(body) <> 'OBJECT' THEN 'not_an_object'
       WHEN len(list_filter(json_keys(body), lambda k: lower(k) NOT IN
            ('idempotency_key', 'recipient', 'channel', 'content', 'priority'))) > 0 THEN 'unknown_field'
       WHEN NOT (coalesce(json_type(body, '$.idempotency_key'), 'NULL') IN ('VARCHAR', 'NULL')
             AND coalesce(json_type(body, '$.recipient'), 'NULL') IN ('VARCHAR', 'NULL')
             AND coalesce(json_type(body, '$.channel'), 'NULL') IN ('VARCHAR', 'NULL')
             AND coalesce(json_type(body, '$.content'), 'NULL') IN ('VARCHAR', 'NULL')
             AND coalesce(json_type(body, '$.priority'), 'NULL') IN ('VARCHAR', 'NULL')) THEN 'wrong_type'
  END AS error,
  idempotency_key AS k0, recipient AS k1, channel AS k2, content AS k3, priority AS k4
FROM (SELECT seq, body,
  CASE WHEN json_valid(body) AND body <> '' THEN coalesce(body ->> '$.idempotency_key', '') END AS idempotency_key,
  CASE WHEN json_valid(body) AND body <> '' THEN coalesce(body ->> '$.recipient', '') END AS recipient,
  CASE WHEN json_valid(body) AND body <> '' THEN coalesce(body ->> '$.CHANNEL', body ->> '$.channel', '') END AS channel,
  CASE WHEN json_valid(body) AND body <> '' THEN coalesce(body ->> '$.content', '') END AS content,
  CASE WHEN json_valid(body) AND body <> '' THEN coalesce(body ->> '$.priority', '') END AS priority
  FROM request_json))"""
BATCH_ROWS_SQL = """WITH b AS (
  SELECT batch_no, body, CAST(body AS JSON) AS j FROM batch_json WHERE octet_length(encode(body)) <= 1048576),
 items AS (SELECT batch_no, json_array_length(j) AS n, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS i, j FROM b),
 rows AS (SELECT batch_no, n, i + 1 AS row_no, json_extract(j, '$[' || i || ']') AS item FROM items),
 checked AS (SELECT *, len(list_filter(json_keys(item), lambda k: lower(k) NOT IN
      ('idempotency_key', 'recipient', 'channel', 'content', 'priority'))) > 0
    OR coalesce(json_type(item, '$.priority'), 'NULL') NOT IN ('VARCHAR', 'NULL') AS bad FROM rows),
 good AS (SELECT batch_no FROM checked GROUP BY batch_no HAVING NOT bool_or(bad) AND max(n) BETWEEN 1 AND 1000)
SELECT c.batch_no, c.row_no,
  coalesce(item ->> '$.idempotency_key', '') AS idempotency_key,
  coalesce(item ->> '$.recipient', '') AS recipient,
  coalesce(item ->> '$.CHANNEL', item ->> '$.channel', '') AS channel,
  coalesce(item ->> '$.content', '') AS content,
  coalesce(item ->> '$.priority', '') AS priority
FROM checked c JOIN good g USING (batch_no)"""


@query("ingest_strict_json", DECODED_SQL, ("request_json",))
def ingest_strict_json(spark, sf):
    p = ingest.parse_requests(D.request_json(spark, sf), "body")
    return p.select("seq", "error", *ingest.REQUEST_FIELDS)


@query("ingest_batch_explode", BATCH_ROWS_SQL, ("batch_json",))
def ingest_batch_explode(spark, sf):
    rows, _rejected = ingest.parse_batches(D.batch_json(spark, sf), "body", "batch_no")
    return rows


@query("batch_rejections", """WITH b AS (SELECT batch_no, CAST(body AS JSON) AS j FROM batch_json WHERE octet_length(encode(body)) <= 1048576),
 items AS (SELECT batch_no, json_array_length(j) AS n,
   unnest(CASE WHEN json_array_length(j) = 0 THEN [NULL::BIGINT] ELSE range(CAST(json_array_length(j) AS BIGINT)) END) AS i,
   j FROM b),
 rows AS (SELECT batch_no, n, json_extract(j, '$[' || i || ']') AS item FROM items),
 checked AS (SELECT batch_no, n, item IS NOT NULL AND (len(list_filter(json_keys(item), lambda k: lower(k) NOT IN
      ('idempotency_key', 'recipient', 'channel', 'content', 'priority'))) > 0
    OR coalesce(json_type(item, '$.priority'), 'NULL') NOT IN ('VARCHAR', 'NULL')) AS bad FROM rows)
SELECT batch_no, CASE WHEN max(n) = 0 THEN 'empty_batch' WHEN max(n) > 1000 THEN 'batch_too_large'
  ELSE 'bad_item' END AS error
FROM checked GROUP BY batch_no HAVING max(n) = 0 OR max(n) > 1000 OR bool_or(bad)
UNION ALL SELECT batch_no, 'body_too_large' FROM batch_json WHERE octet_length(encode(body)) > 1048576""", ("batch_json",))
def batch_rejections(spark, sf):
    _rows, rejected = ingest.parse_batches(D.batch_json(spark, sf), "body", "batch_no")
    return rejected


# ----------------------------------------------------------------------- projections
@query("uuid_valid", """WITH ids AS (
  SELECT o_orderkey AS k, '00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS u FROM orders),
 spelled AS (SELECT k, CASE k % 6 WHEN 0 THEN u WHEN 1 THEN upper(u) WHEN 2 THEN 'urn:uuid:' || u
   WHEN 3 THEN '{' || u || '}' WHEN 4 THEN replace(u, '-', '') ELSE u || 'z' END AS input FROM ids)
SELECT k, input,
  regexp_full_match(input, '(?i)(urn:uuid:)?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\\{[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\}|[0-9a-f]{32}') AS ok,
  CASE WHEN regexp_full_match(input, '(?i)(urn:uuid:)?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\\{[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\}|[0-9a-f]{32}')
    THEN (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
          FROM (SELECT lower(regexp_replace(regexp_replace(input, '(?i)^urn:uuid:', ''), '[-{}]', '', 'g')) AS h)) END AS canonical
FROM spelled""")
def uuid_valid(spark, sf):
    return projections.uuid_spellings(spark, sf)


@query("limit_clamp", """SELECT event_id AS seq, raw,
  CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') AND TRY_CAST(raw AS BIGINT) BETWEEN 1 AND 100
       THEN CAST(raw AS INT) ELSE 10 END AS "limit"
FROM (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'abc' WHEN event_id % 19 = 0 THEN ''
  WHEN event_id % 23 = 0 THEN '00000000' || CAST(event_id % 130 AS VARCHAR)
  WHEN event_id % 29 = 0 THEN CAST(event_id % 130 AS VARCHAR) || '00000000000000000000'
  ELSE CAST(event_id % 130 - 10 AS VARCHAR) END AS raw FROM events)""")
def limit_clamp(spark, sf):
    return projections.limit_clamp_table(spark, sf)


@query("classify_http", """SELECT id, attempt_no, http_status,
  CASE WHEN http_status IS NULL OR http_status >= 500 OR http_status IN (429, 408) THEN 'retriable'
       WHEN http_status BETWEEN 200 AND 299 THEN 'delivered' ELSE 'permanent' END AS outcome
FROM attempts""", ("attempts",))
def classify_http(spark, sf):
    a = D.attempts(spark, sf)
    return a.select("id", "attempt_no", "http_status", projections.classify_http("http_status").alias("outcome"))


@query("route_priority", """SELECT id, priority,
  CASE priority WHEN 'high' THEN 'notifications-high' WHEN 'low' THEN 'notifications-low'
       ELSE 'notifications-normal' END AS topic FROM notifications""", ("notifications",))
def route_priority(spark, sf):
    n = D.notifications(spark, sf)
    return n.select("id", "priority", projections.route_priority("priority").alias("topic"))


@query("payload_projection", """SELECT id, '{"id":"' || id || '","correlation_id":' ||
  CASE WHEN correlation_id IS NULL THEN 'null' ELSE '"' || correlation_id || '"' END ||
  ',"recipient":"' || recipient || '","channel":"' || channel || '","content":"' || content ||
  '","priority":"' || priority || '"}' AS payload FROM notifications""", ("notifications",))
def payload_projection(spark, sf):
    n = D.notifications(spark, sf)
    return n.select("id", projections.payload_json(keep_nulls=True).alias("payload"))


@query("client_ip", r"""SELECT seq, CASE WHEN xff <> '' THEN trim(split_part(xff, ',', 1))
  WHEN regexp_full_match(remote, '\[[^\[\]]*\]:[^:\[\]]*') THEN regexp_extract(remote, '^\[([^\[\]]*)\]:', 1)
  WHEN regexp_full_match(remote, '[^:\[\]]*:[^:\[\]]*') THEN trim(regexp_extract(remote, '^([^:]*):', 1)) ELSE '' END AS client_ip
FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN '' ELSE xff END AS xff,
  CASE WHEN seq % 5 = 0 THEN '10.1.1.1' ELSE '192.168.1.' || CAST(seq % 250 AS VARCHAR) || ':' ||
    CAST(1000 + seq % 1000 AS VARCHAR) END AS remote FROM requests)""", ("requests",))
def client_ip(spark, sf):
    return projections.client_ip_table(D.requests(spark, sf))


@query("correlation_id", """SELECT id, CASE WHEN coalesce(correlation_id, '') = '' THEN 'generated' ELSE 'given' END AS source,
  CAST(CASE WHEN coalesce(correlation_id, '') = '' THEN 36 ELSE length(correlation_id) END AS INTEGER) AS id_len
FROM notifications""", ("notifications",))
def correlation_id(spark, sf):
    n = D.notifications(spark, sf)
    c = projections.correlation_id("correlation_id")
    return n.select("id", F.when(F.coalesce(F.col("correlation_id"), F.lit("")) == "", "generated")
                    .otherwise("given").alias("source"), F.length(c).alias("id_len"))


@query("webhook_body", """SELECT id, '{"to":"' || recipient || '","channel":"' || channel ||
  '","content":"' || content || '"}' AS body FROM notifications""", ("notifications",))
def webhook_body(spark, sf):
    n = D.notifications(spark, sf)
    return n.select("id", projections.webhook_body().alias("body"))


@query("correlation_trace", """SELECT n.correlation_id, count(a.id) AS attempts, count(DISTINCT n.id) AS notifications,
  min(a.attempt_ts) AS first_attempt, max(a.attempt_ts) AS last_attempt
FROM notifications n LEFT JOIN attempts a ON a.id = n.id
WHERE n.correlation_id IS NOT NULL GROUP BY n.correlation_id""", ("notifications", "attempts"))
def correlation_trace(spark, sf):
    """P26 trace: everything that happened under one correlation id (attempts joined to
    their notification, then one partial/final aggregate per correlation id)."""
    n = D.notifications(spark, sf).where(F.col("correlation_id").isNotNull()).select("id", "correlation_id")
    a = D.attempts(spark, sf).select(F.col("id").alias("aid"), "attempt_ts")
    j = n.join(a, n["id"] == a["aid"], "left")
    return j.groupBy("correlation_id").agg(F.count("aid").alias("attempts"),
                                           F.count_distinct("id").alias("notifications"),
                                           F.min("attempt_ts").alias("first_attempt"),
                                           F.max("attempt_ts").alias("last_attempt"))
