"""Rate-limit and breaker queries.

The oracles replay the same rules in DuckDB with a recursive CTE per key (one row per
step), an independent statement of the fold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.operators import breaker as B
from missive.operators import limits as L
from missive.operators import metrics as A
from missive.operators.token_bucket import amounts
from missive.plans.registry import query
from missive.sources import derived as D

# Parameters of the fixture runs (see FIXTURES.md: limiter inputs, calls).
FIXED_LIMIT = 1
SLIDING_LIMIT, SLIDING_WINDOW_MS = 2, 15 * 60 * 1000
BUCKET_CAPACITY, BUCKET_RATE = 10, 1 / 600
BREAKER = dict(max_failures=2, window_s=2 * 3600, open_s=3600)


@query("limit_fixed", """SELECT req_id, key, n <= 1 AS allowed FROM (
  SELECT req_id, key, row_number() OVER (PARTITION BY key, epoch_us(ts) // 1000000 ORDER BY ts, req_id) AS n
  FROM limiter_requests)""", ("limiter_requests",))
def limit_fixed(spark, sf):
    return L.limit_fixed(D.limiter_requests(spark, sf), "key", "ts", "req_id", FIXED_LIMIT) \
            .select("req_id", "key", "allowed")


_SLIDING_SQL = f"""WITH RECURSIVE src AS (
  SELECT key, req_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY key ORDER BY epoch_ms(ts), req_id) AS rn
  FROM limiter_requests),
r AS (
  SELECT key, rn, req_id, true AS allowed, [ms] AS log FROM src WHERE rn = 1
  UNION ALL
  SELECT key, rn, req_id, len(kept) < {SLIDING_LIMIT} AS allowed,
    CASE WHEN len(kept) < {SLIDING_LIMIT} THEN list_append(kept, ms) ELSE kept END AS log
  FROM (SELECT s.key, s.rn, s.req_id, s.ms, list_filter(r.log, lambda x: x > s.ms - {SLIDING_WINDOW_MS}) AS kept
        FROM r JOIN src s ON s.key = r.key AND s.rn = r.rn + 1))
SELECT req_id, key, allowed FROM r"""


@query("limit_sliding", _SLIDING_SQL, ("limiter_requests",))
def limit_sliding(spark, sf):
    return L.limit_sliding(D.limiter_requests(spark, sf), "key", "ts", "req_id", SLIDING_LIMIT,
                           SLIDING_WINDOW_MS).select("req_id", "key", "allowed")


def _bucket_sql(src: str, cap, rate) -> str:
    """Replay in whole units of 1 / (10^6 q) tokens (rate = p / q)."""
    unit, p, full = amounts(cap, rate)
    return f"""WITH RECURSIVE src AS (
  SELECT key, req_id, weight::HUGEINT * {unit} AS w, epoch_us(ts)::HUGEINT AS us,
    row_number() OVER (PARTITION BY key ORDER BY epoch_us(ts), req_id) AS rn FROM {src}),
r AS (
  SELECT key, rn, req_id, {full} >= w AS allowed, CASE WHEN {full} >= w THEN {full} - w ELSE {full}::HUGEINT END AS tokens, us AS last
  FROM src WHERE rn = 1
  UNION ALL
  SELECT key, rn, req_id, refilled >= w, CASE WHEN refilled >= w THEN refilled - w ELSE refilled END, us
  FROM (SELECT s.key, s.rn, s.req_id, s.w, s.us, least({full}::HUGEINT, r.tokens + (s.us - r.last) * {p}) AS refilled
        FROM r JOIN src s ON s.key = r.key AND s.rn = r.rn + 1))
SELECT req_id, key, allowed, round(tokens::DOUBLE / {float(unit)!r}, 9) AS tokens_left FROM r"""


@query("limit_token_bucket", _bucket_sql("limiter_requests", BUCKET_CAPACITY, BUCKET_RATE), ("limiter_requests",))
def limit_token_bucket(spark, sf):
    r = L.limit_token_bucket(D.limiter_requests(spark, sf), "key", "ts", "req_id", "weight",
                             BUCKET_CAPACITY, BUCKET_RATE)
    return r.select("req_id", "key", "allowed", F.round("tokens_left", 9).alias("tokens_left"))


@query("fail_policy", """SELECT req_id, key, CASE WHEN req_id % 10 = 0 THEN true ELSE allowed END AS api_allowed,
  CASE WHEN req_id % 10 = 0 THEN false ELSE allowed END AS worker_allowed FROM (
  SELECT req_id, key, n <= 1 AS allowed FROM (
  SELECT req_id, key, row_number() OVER (PARTITION BY key, epoch_us(ts) // 1000000 ORDER BY ts, req_id) AS n
  FROM limiter_requests))""", ("limiter_requests",))
def fail_policy(spark, sf):
    """Every tenth verdict is lost (store down): the API lets it pass, the worker not."""
    r = L.limit_fixed(D.limiter_requests(spark, sf), "key", "ts", "req_id", FIXED_LIMIT)
    v = F.when(F.col("req_id") % 10 != 0, F.col("allowed"))
    return r.select("req_id", "key", L.fail_policy(v, True).alias("api_allowed"),
                    L.fail_policy(v, False).alias("worker_allowed"))


def _replay(spark, sf):
    return B.breaker_replay(D.calls(spark, sf), **BREAKER)


def breaker_sql(src: str, max_failures: int, window_s: int, open_s: int, final: str | None = None) -> str:
    """Recursive replay of the breaker rules over ``src`` (name, call_id, ts, ok); the
    result view ``rep`` has one row per call with verdict/executed/tripped."""
    us = "CAST(1000000 AS BIGINT)"
    trips = f"(CASE WHEN fu IS NOT NULL AND t < fu THEN fails + 1 ELSE 1 END) >= {max_failures}"
    nxt = "(CASE WHEN fu IS NOT NULL AND t < fu THEN fails + 1 ELSE 1 END)"
    final = final or "SELECT call_id, name, verdict, executed, tripped FROM rep"
    return f"""WITH RECURSIVE src AS (
  SELECT name, call_id, ts, ok, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY name ORDER BY epoch_us(ts), call_id) AS rn FROM {src}),
r AS (
  SELECT name, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS st, CAST(NULL AS BIGINT) AS hf,
    CAST(NULL AS BIGINT) AS pr, 0 AS fails, CAST(NULL AS BIGINT) AS fu, CAST(NULL AS VARCHAR) AS verdict,
    false AS tripped FROM (SELECT DISTINCT name FROM src)
  UNION ALL
  SELECT name, rn,
    CASE WHEN v <> 'open' AND ok THEN NULL
         WHEN v = 'probe' THEN t + {open_s} * {us}
         WHEN v = 'closed' AND {trips} THEN t + {open_s} * {us} ELSE st END,
    CASE WHEN v <> 'open' AND ok THEN NULL
         WHEN v = 'probe' THEN t + {open_s + 5} * {us}
         WHEN v = 'closed' AND {trips} THEN t + {open_s + 5} * {us} ELSE hf END,
    CASE WHEN v <> 'open' AND ok THEN NULL WHEN v = 'probe' AND NOT ok THEN NULL
         WHEN v = 'probe' THEN t + 10 * {us} ELSE pr END,
    CASE WHEN v <> 'open' AND ok THEN 0 WHEN v = 'closed' THEN CASE WHEN {trips} THEN 0 ELSE {nxt} END
         ELSE fails END,
    CASE WHEN v <> 'open' AND ok THEN NULL WHEN v = 'closed' THEN
           CASE WHEN {trips} THEN NULL WHEN fu IS NOT NULL AND t < fu THEN fu ELSE t + {window_s} * {us} END
         ELSE fu END,
    v, NOT ok AND (v = 'probe' OR (v = 'closed' AND {trips}))
  FROM (SELECT *,
      CASE WHEN st IS NOT NULL AND t < st THEN 'open'
           WHEN hf IS NOT NULL AND t < hf THEN CASE WHEN pr IS NOT NULL AND t < pr THEN 'open' ELSE 'probe' END
           ELSE 'closed' END AS v
    FROM (SELECT s.name, s.ts, s.ok, s.t, s.rn, r.st, r.hf, r.pr, r.fails, r.fu
          FROM r JOIN src s ON s.name = r.name AND s.rn = r.rn + 1))),
rep AS (SELECT s.call_id, s.name, s.ts, r.verdict, r.verdict <> 'open' AS executed, r.tripped
  FROM r JOIN src s ON s.name = r.name AND s.rn = r.rn WHERE r.rn > 0)
{final}"""


_BREAKER_SQL = breaker_sql("calls", **BREAKER)


def _breaker_final(final: str) -> str:
    return breaker_sql("calls", **BREAKER, final=final)


@query("breaker_replay", _BREAKER_SQL, ("calls",))
def breaker_replay(spark, sf):
    return _replay(spark, sf).select("call_id", "name", "verdict", "executed", "tripped")


@query("breaker_intervals", _breaker_final(
    f"""SELECT name, ts AS opened_at, ts + INTERVAL {BREAKER['open_s']} SECOND AS closes_at FROM rep WHERE tripped"""),
    ("calls",))
def breaker_intervals(spark, sf):
    return B.breaker_intervals(_replay(spark, sf), open_s=BREAKER["open_s"])


@query("breaker_downtime", _breaker_final(
    f"""SELECT name, count(*) AS trips, CAST(count(*) * {BREAKER['open_s']} AS BIGINT) AS downtime_s, max(ts) AS last_opened_at
  FROM rep WHERE tripped GROUP BY name"""), ("calls",))
def breaker_downtime(spark, sf):
    """B2: how often and how long every breaker was open (its intervals never overlap)."""
    i = B.breaker_intervals(_replay(spark, sf), open_s=BREAKER["open_s"])
    seconds = F.unix_seconds(F.col("closes_at").cast("timestamp")) - F.unix_seconds(F.col("opened_at").cast("timestamp"))
    return i.groupBy("name").agg(F.count(F.lit(1)).alias("trips"), F.sum(seconds).alias("downtime_s"), F.max("opened_at").alias("last_opened_at"))


@query("breaker_trips", _breaker_final("SELECT count(*) AS value FROM rep WHERE tripped"), ("calls",))
def breaker_trips(spark, sf, replayed=None):
    """closed/half-open -> open edges."""
    r = replayed if replayed is not None else _replay(spark, sf)
    return A.counter(r.where("tripped"), [])


@query("breaker_state", _breaker_final(
    """SELECT name, CAST(CASE WHEN arg_max(verdict, (ts, call_id)) = 'open' OR arg_max(tripped, (ts, call_id))
      THEN 1 ELSE 0 END AS INT) AS value FROM rep GROUP BY name"""), ("calls",))
def breaker_state(spark, sf, replayed=None):
    """Gauge per breaker after its last call (1 = open, 0 = closed)."""
    r = replayed if replayed is not None else _replay(spark, sf)
    last = F.max_by(F.struct("verdict", "tripped"), F.struct("ts", "call_id"))
    g = r.groupBy("name").agg(last.alias("l"))
    return g.select("name", F.when((F.col("l.verdict") == "open") | F.col("l.tripped"), 1).otherwise(0)
                    .cast("int").alias("value"))


@query("breaker_asof", _breaker_final(
    f"""SELECT m.msg_id, m.name, EXISTS (SELECT 1 FROM rep
      WHERE rep.tripped AND rep.name = m.name AND rep.ts <= m.ts AND m.ts < rep.ts + INTERVAL {BREAKER['open_s']} SECOND)
      AS breaker_open
    FROM (SELECT msg_id, 'hook_' || CAST(id % 4 AS VARCHAR) AS name, ts FROM messages) m"""), ("calls", "messages"))
def breaker_asof(spark, sf):
    trips = _replay(spark, sf).where("tripped").select("name", "ts")
    fetches = D.messages(spark, sf).select("msg_id", F.concat(F.lit("hook_"), (F.col("id") % 4).cast("string"))
                                           .alias("name"), "ts")
    return B.breaker_open_at(fetches, trips, open_s=BREAKER["open_s"]).select("msg_id", "name", "breaker_open")
