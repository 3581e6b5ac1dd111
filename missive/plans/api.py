"""API calls on their token bucket: L4, A4, A6.

The fixture's bucket is small (its traffic is a few calls per client and day), so that
calls are refused; the production values are ``api_calls.CAPACITY`` and ``RATE``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.operators import api_calls as AC
from missive.operators import disposition as DS
from missive.operators import limits as L
from missive.operators import metrics as A
from missive.operators.projections import client_ip
from missive.plans.dispatch import _CALLS, _FINAL, disposition
from missive.plans.limits import _bucket_sql, breaker_sql
from missive.plans.metrics import _hist_sql
from missive.plans.registry import query
from missive.plans.validation import BATCH_ROWS_SQL, DECODED_SQL, _FIRST_ERROR, _NORM
from missive.sources import derived as D
from missive.sources.tables import dealt_tables

API_CAPACITY, API_RATE = 20, 1 / 7200
FLOOD_LIMIT, FLOOD_WINDOW_MS = 2, 3_600_000

_IP = "'api_tokens:' || trim(split_part(xff, ',', 1))"
# valid singles and decoded batch items, normalised
_SINGLES = f"""(SELECT 's-' || seq AS call_id, idempotency_key, xff, arrival_ts FROM (SELECT *, {_FIRST_ERROR} AS error2 FROM (
  {_NORM.replace("SELECT seq, batch_no,", "SELECT seq,").replace("FROM requests", f"FROM ({DECODED_SQL}) WHERE error IS NULL")}))
  JOIN (SELECT seq, xff, arrival_ts FROM requests) USING (seq) WHERE error2 IS NULL)"""
_ITEMS = f"""(SELECT *, {_FIRST_ERROR} AS error FROM (
  {_NORM.replace("SELECT seq, batch_no,", "SELECT batch_no, row_no,").replace("FROM requests", f"FROM ({BATCH_ROWS_SQL})")}))"""
QUOTA_CALLS = f"""(SELECT call_id, call_id AS req_id, {_IP} AS key, arrival_ts AS ts, 1 AS weight FROM {_SINGLES}
  UNION ALL SELECT 'b-' || batch_no, 'b-' || batch_no, {_IP}, arrival_ts, n FROM (
    SELECT batch_no, CAST(count(*) AS INT) AS n FROM {_ITEMS} GROUP BY batch_no) JOIN batch_json USING (batch_no))"""
_VERDICTS = _bucket_sql(QUOTA_CALLS, API_CAPACITY, API_RATE)


def decoded(spark, sf) -> AC.ApiCalls:
    with dealt_tables("events"):          # a body is written and parsed per row; those of batches are dealt by batch
        singles = D.request_json(spark, sf)
    return AC.decode_calls(singles, D.batch_json(spark, sf), client_ip(F.col("xff"), F.lit("")))


@query("limit_weighted_batches", _VERDICTS.replace("SELECT req_id, key,", "SELECT req_id AS call_id, key,"), ("batch_json",))
def limit_weighted_batches(spark, sf):
    """L4: one bucket per client address for single requests (weight 1, after validation)
    and batches (weight = items, after strict decoding, before validation)."""
    r = AC.quota(decoded(spark, sf).calls, API_CAPACITY, API_RATE)
    return r.select("call_id", "key", "allowed", F.round("tokens_left", 9).alias("tokens_left"))


_COMMITTED = f"""(WITH RECURSIVE verdict AS ({_VERDICTS}),
items AS (SELECT 'b-' || batch_no AS call_id, * FROM {_ITEMS}),
mem AS (
  SELECT call_id, arrival_ts AS ts, idempotency_key AS k, false AS bad FROM {_SINGLES}
  UNION ALL SELECT call_id, arrival_ts, idempotency_key, error IS NOT NULL FROM items JOIN (SELECT batch_no, arrival_ts FROM batch_json) USING (batch_no)),
live AS (SELECT m.*, count(*) OVER (PARTITION BY m.call_id, k) AS twice FROM mem m JOIN verdict v ON v.req_id = m.call_id AND v.allowed),
bk AS (
  SELECT l.call_id, list(k) AS ks, count(*) AS n, min(ts) AS ts, bool_or(bad) OR max(twice) > 1 OR bool_or(n.idempotency_key IS NOT NULL) AS refused
  FROM live l LEFT JOIN notifications n ON n.idempotency_key = l.k GROUP BY l.call_id),
-- only keys that several calls hold can refuse one, and only calls that hold one of them need the replay
shared AS (SELECT k FROM bk, unnest(ks) u(k) WHERE NOT refused GROUP BY k HAVING count(*) > 1),
held AS (SELECT call_id, n, list(k) AS ks, row_number() OVER (ORDER BY min(ts), call_id) AS rn
         FROM (SELECT bk.call_id, n, ts, refused, u.k FROM bk, unnest(ks) u(k)) JOIN shared USING (k) WHERE NOT refused GROUP BY call_id, n),
r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS call_id, CAST(0 AS BIGINT) AS n, false AS admitted, CAST([] AS VARCHAR[]) AS taken
  UNION ALL
  SELECT b.rn, b.call_id, b.n, NOT list_has_any(r.taken, b.ks), CASE WHEN NOT list_has_any(r.taken, b.ks) THEN list_concat(r.taken, b.ks) ELSE r.taken END
  FROM r JOIN held b ON b.rn = r.rn + 1)
SELECT call_id, n AS size FROM bk WHERE NOT refused AND call_id LIKE 'b-%' AND call_id NOT IN (SELECT call_id FROM held)
UNION ALL SELECT call_id, n FROM r WHERE admitted AND call_id LIKE 'b-%')"""


@query("batch_size_hist", f"WITH sizes AS MATERIALIZED {_COMMITTED}\n" + _hist_sql("sizes", [], "size", A.BATCH_SIZE_BUCKETS), ("batch_json", "notifications"))
def batch_size_hist(spark, sf):
    """A4: sizes of the batches that pass quota, validation and commit."""
    api = decoded(spark, sf)
    done = AC.committed(api, AC.quota(api.calls, API_CAPACITY, API_RATE), D.notifications(spark, sf))
    sizes = done.where(F.col("call_id").startswith("b-")).select(F.col("weight").alias("size"))
    return A.histogram(sizes, [], "size", A.BATCH_SIZE_BUCKETS)


# --------------------------------------------------------------------------- A6
_FLOOD_SQL = f"""(WITH RECURSIVE src AS (
  SELECT trim(split_part(xff, ',', 1)) AS key, seq, epoch_ms(arrival_ts) AS ms,
    row_number() OVER (PARTITION BY trim(split_part(xff, ',', 1)) ORDER BY epoch_ms(arrival_ts), seq) AS rn FROM requests),
r AS (SELECT key, rn, true AS allowed, [ms] AS log FROM src WHERE rn = 1
  UNION ALL
  SELECT key, rn, len(kept) < {FLOOD_LIMIT},
    CASE WHEN len(kept) < {FLOOD_LIMIT} THEN list_append(kept, ms) ELSE kept END
  FROM (SELECT s.key, s.rn, s.ms, list_filter(r.log, lambda x: x > s.ms - {FLOOD_WINDOW_MS}) AS kept
        FROM r JOIN src s ON s.key = r.key AND s.rn = r.rn + 1))
SELECT count(*) FILTER (WHERE NOT allowed) FROM r)"""
_TOKEN_SQL = f"(SELECT count(*) FILTER (WHERE NOT allowed) FROM ({_VERDICTS}))"
_CHANNEL_SQL = "(" + breaker_sql(_CALLS, DS.BREAKER_MAX, DS.BREAKER_WINDOW_S, DS.BREAKER_OPEN_S, final=_FINAL) \
    .replace("SELECT msg_id, nid, disposition FROM (", "SELECT count(*) FILTER (WHERE disposition = 'retry_limited') FROM (", 1) + ")"
RATE_LIMIT_SQL = f"""SELECT 'global_flood' AS limiter_type, CAST({_FLOOD_SQL} AS BIGINT) AS value
UNION ALL SELECT 'token_bucket', CAST({_TOKEN_SQL} AS BIGINT)
UNION ALL SELECT 'channel_sliding', CAST({_CHANNEL_SQL} AS BIGINT)"""


@query("rate_limit_hits", RATE_LIMIT_SQL, ("requests", "batch_json", "outbox", "notifications", "attempts", "cancel_requests"))
def rate_limit_hits(spark, sf):
    """Refusals per limiter: API flood guard (sliding log per client address), API token
    bucket (single requests and batches), worker channel limiter."""
    return hits(spark, sf, AC.quota(decoded(spark, sf).calls, API_CAPACITY, API_RATE), disposition(spark, sf))


def hits(spark, sf, verdicts, decided):
    """Refusals per limiter, from the bucket's verdicts and the worker's dispositions."""
    reqs = D.requests(spark, sf)
    ip = client_ip(F.col("xff"), F.lit(""))
    flood = L.limit_sliding(reqs.select("seq", "arrival_ts", ip.alias("ip")), "ip", "arrival_ts", "seq", FLOOD_LIMIT, FLOOD_WINDOW_MS)
    refused = [("global_flood", flood.where("NOT allowed")), ("token_bucket", verdicts.where("NOT allowed")),
               ("channel_sliding", decided.where("disposition = 'retry_limited'"))]
    out = None
    for name, rows in refused:
        n = rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("limiter_type"), "value")
        out = n if out is None else out.unionByName(n)
    return out
