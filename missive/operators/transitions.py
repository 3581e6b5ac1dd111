"""Snapshot transitions (M1-M9) as guarded ``when`` per column: one scan, one join.

Signature style: ``apply_x(snapshot, events, as_of, ...) -> (new_snapshot, emitted)``.
On a table format with MERGE the same guards become ``WHEN MATCHED AND`` clauses.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.functions.timefmt import ntz_lit
from missive.operators.projections import classify_http, payload_json
from missive.sources.derived import uuid_from

# Fixed values of the delivery rules.
MAX_RETRIES = 3
RATE_LIMIT_DELAY = "INTERVAL 10 SECONDS"
ZOMBIE_AGE = "INTERVAL 5 MINUTES"
TERMINAL = ("delivered", "failed_permanently")
CANCELABLE = ("pending", "failed_retrying")

SNAPSHOT_COLS = ["id", "batch_id", "idempotency_key", "recipient", "channel", "content",
                 "priority", "status", "external_id", "retry_count", "next_retry_at",
                 "correlation_id", "created_at", "updated_at"]


# ------------------------------------------------------------------------ predicates
def lock_eligible(as_of) -> Column:
    """Pending, or failed_retrying whose retry time has come."""
    now = ntz_lit(as_of) if isinstance(as_of, _dt.datetime) else as_of
    return (F.col("status") == "pending") | \
           ((F.col("status") == "failed_retrying") & (F.col("next_retry_at") <= now))


def cancel_eligible() -> Column:
    """P19."""
    return F.col("status").isin(*CANCELABLE)


def zombie(as_of) -> Column:
    """Processing and untouched for more than five minutes (strict)."""
    now = ntz_lit(as_of) if isinstance(as_of, _dt.datetime) else as_of
    return (F.col("status") == "processing") & (F.col("updated_at") < now - F.expr(ZOMBIE_AGE))


def lookup_ids(snapshot: DataFrame, ids: DataFrame, col: str = "id") -> DataFrame:
    """P14 bulk / J3: rows whose id is in ``ids`` (left semi join, ids de-duplicated by it)."""
    return snapshot.join(ids.select(col), on=col, how="left_semi")


def first_per_key(df: DataFrame, key: str, order: str, out: str = "_first") -> DataFrame:
    """Mark the first row of each key along ``order`` without a per-key window.

    ``min(order)`` per key is a partial aggregate (a hot key is combined map-side); rows
    equal to it are the first, and only among exact ties (identical order values) does a
    window run, partitioned by (key, order) - a group of identical rows, not a key.
    """
    m = df.groupBy(key).agg(F.min(order).alias("_min"))
    x = df.join(m, key, "left")
    w = Window.partitionBy(key, order).orderBy(order)
    tie = F.row_number().over(w)
    at_min = F.col(order) == F.col("_min")
    return (x.withColumn(out, at_min)
             .withColumn(out, F.when(F.col(out), tie == 1).otherwise(F.lit(False)))
             .drop("_min"))


def backoff(retry_count: Column) -> Column:
    """2^n minutes as a day-time interval (n = retry count before the failure)."""
    return F.make_dt_interval(mins=F.pow(F.lit(2), retry_count).cast("int"))


# ------------------------------------------------------------------------ M1 create
def apply_create(valid_requests: DataFrame, batch_id: Column | None = None,
                 created_at: str = "arrival_ts") -> tuple[DataFrame, DataFrame]:
    """M1: admitted requests -> pending rows and their outbox rows (both from one frame).

    A request's correlation id is carried onto its row and payload; a request without one
    gets its own.  ``batch_id`` names the batch of a batch request (null: single request).
    """
    ids = uuid_from(F.col("seq"), "3")          # deterministic ids per admitted request
    own = uuid_from(F.col("seq"), "5")
    given = F.col("correlation_id") if "correlation_id" in valid_requests.columns else F.lit(None).cast("string")
    rows = valid_requests.select(
        ids.alias("id"),
        (batch_id if batch_id is not None else F.lit(None).cast("string")).alias("batch_id"),
        "idempotency_key", "recipient", "channel", "content", "priority",
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("external_id"),
        F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp_ntz").alias("next_retry_at"),
        F.coalesce(F.nullif(given, F.lit("")), own).alias("correlation_id"),
        F.col(created_at).alias("created_at"), F.col(created_at).alias("updated_at"))
    return rows, outbox_rows(rows)


def outbox_rows(rows: DataFrame) -> DataFrame:
    """The 'NotificationCreated' outbox row of each new notification row."""
    return rows.select(
        F.concat(F.lit("o-"), F.col("id")).alias("id"),
        F.col("id").alias("aggregate_id"), F.lit("NotificationCreated").alias("event_type"),
        payload_json().alias("payload"), F.lit("pending").alias("status"), "created_at")


# ------------------------------------------------------------------------ M2 lock
def apply_lock(snapshot: DataFrame, msgs: DataFrame, as_of: _dt.datetime,
               order_col: str = "msg_id") -> tuple[DataFrame, DataFrame]:
    """M2: the first message per id takes an eligible row (compare-and-set); others lose.

    Returns (new snapshot, per-message verdict ``taken``).
    """
    first = first_per_key(msgs, "id", order_col, "_first")
    cur = snapshot.select("id", "status", "next_retry_at")
    v = first.join(cur, "id", "left")
    taken = F.coalesce(F.col("_first") & lock_eligible(as_of), F.lit(False))
    verdict = v.select(order_col, "id", taken.alias("taken"),
                       F.col("status").isNull().alias("missing"))
    hit = msgs.select("id").distinct()
    now = ntz_lit(as_of)
    s = snapshot.join(hit.withColumn("_hit", F.lit(True)), "id", "left")
    go = F.coalesce(F.col("_hit"), F.lit(False)) & lock_eligible(as_of)
    new = s.select(*[F.when(go, F.lit("processing")).otherwise(F.col(c)).alias(c) if c == "status"
                     else F.when(go, now).otherwise(F.col(c)).alias(c) if c == "updated_at"
                     else F.col(c) for c in SNAPSHOT_COLS])
    return new, verdict


# ------------------------------------------------------------------------ M3 cancel
def apply_cancel(snapshot: DataFrame, requests: DataFrame, as_of: _dt.datetime,
                 order_col: str = "req_id", cancelable=CANCELABLE) -> tuple[DataFrame, DataFrame]:
    """M3: canceled / not_found / refused(current status) per request; the first request
    per id wins, later ones see ``canceled``."""
    r = first_per_key(requests, "id", order_col, "_first") \
        .withColumn("_rn", F.when(F.col("_first"), 1).otherwise(2))
    v = r.join(snapshot.select("id", "status"), "id", "left")
    ok = F.col("status").isin(*cancelable)
    seen = F.when((F.col("_rn") > 1) & ok, F.lit("canceled")).otherwise(F.col("status"))
    result = (F.when(F.col("status").isNull(), "not_found")
              .when((F.col("_rn") == 1) & ok, "canceled").otherwise("refused"))
    verdict = v.select(order_col, "id", result.alias("result"),
                       F.when(result == "refused", seen).otherwise(F.lit("")).alias("current_status"))
    hit = requests.select("id").distinct().withColumn("_hit", F.lit(True))
    s = snapshot.join(hit, "id", "left")
    go = F.coalesce(F.col("_hit"), F.lit(False)) & ok
    now = ntz_lit(as_of)
    new = s.select(*[F.when(go, F.lit("canceled")).otherwise(F.col(c)).alias(c) if c == "status"
                     else F.when(go, now).otherwise(F.col(c)).alias(c) if c == "updated_at"
                     else F.col(c) for c in SNAPSHOT_COLS])
    return new, verdict


# ------------------------------------------------------------- M4-M7 outcome rules
def latest_outcome(attempts: DataFrame) -> DataFrame:
    """One outcome per id: the last attempt by (time, number), remaining columns as
    tie-break so equal keys pick equal rows.  ``max_by`` is a partial/final aggregate, so
    a hot id is combined map-side before the shuffle.  The aggregate sorts: a hash of the id
    before the id makes nearly every comparison one of numbers."""
    key = F.struct("attempt_ts", "attempt_no", F.coalesce("http_status", F.lit(-1)),
                   "message_id", "latency_s")
    return (attempts.groupBy(F.xxhash64("id").alias("_h"), "id")
            .agg(F.max_by(F.struct("attempt_ts", "attempt_no", "http_status", "message_id",
                                   "latency_s"), key).alias("a"))
            .select("id", "a.*"))


def outcome_rules(status: Column, retry_count: Column, external_id: Column,
                  next_retry_at: Column, updated_at: Column, outcome: Column,
                  message_id: Column, at: Column, max_retries: int = MAX_RETRIES,
                  limited: Column | None = None) -> dict[str, Column]:
    """M4-M7 as guarded expressions; only rows in ``processing`` change."""
    proc = (status == "processing") & outcome.isNotNull()
    lim = proc & (limited if limited is not None else F.lit(False))
    ok = proc & ~lim & (outcome == "delivered")
    perm_code = proc & ~lim & (outcome == "permanent")
    retr = proc & ~lim & (outcome == "retriable")
    retry_more = retr & (retry_count + 1 < max_retries)
    to_perm = perm_code | (retr & ~(retry_count + 1 < max_retries))
    new_status = (F.when(lim, "failed_retrying").when(ok, "delivered")
                  .when(retry_more, "failed_retrying").when(to_perm, "failed_permanently")
                  .otherwise(status))
    new_count = F.when(retry_more | to_perm, retry_count + 1).otherwise(retry_count)
    new_next = (F.when(lim, at + F.expr(RATE_LIMIT_DELAY))
                .when(retry_more, at + backoff(retry_count))
                .when(to_perm, F.lit(None).cast("timestamp_ntz")).otherwise(next_retry_at))
    # delivered writes the webhook's message id, or null when it sent none
    new_ext = F.when(ok, F.when(message_id != "", message_id)).otherwise(external_id)
    new_upd = F.when(proc, at).otherwise(updated_at)
    return {"status": new_status, "retry_count": new_count.cast("int"),
            "next_retry_at": new_next, "external_id": new_ext, "updated_at": new_upd,
            "dlq": to_perm}


def apply_outcomes(snapshot: DataFrame, attempts: DataFrame,
                   max_retries: int = MAX_RETRIES, keep: tuple[str, ...] = (),
                   latest: DataFrame | None = None) -> DataFrame:
    """J7 + M4/M6/M7: latest outcome per id joined to the snapshot, applied only when
    the row is processing.  Adds ``dlq`` (the permanent failures to publish).  ``latest``:
    ``latest_outcome`` of the attempts where the caller has it at hand."""
    o = (latest if latest is not None else latest_outcome(attempts)).select(
        "id", classify_http("http_status").alias("_outcome"),
        F.col("message_id").alias("_mid"), F.col("attempt_ts").alias("_at"))
    j = snapshot.join(o, "id", "left")
    r = outcome_rules(F.col("status"), F.col("retry_count"), F.col("external_id"),
                      F.col("next_retry_at"), F.col("updated_at"), F.col("_outcome"),
                      F.col("_mid"), F.col("_at"), max_retries)
    return j.select(*[r[c].alias(c) if c in r else F.col(c) for c in SNAPSHOT_COLS],
                    r["dlq"].alias("dlq"), *keep)


def apply_rate_limited(snapshot: DataFrame, refusals: DataFrame) -> DataFrame:
    """M5: processing -> failed_retrying, retry at +10 s, retry_count unchanged."""
    r = refusals.groupBy("id").agg(F.max("ts").alias("_at"))
    j = snapshot.join(r, "id", "left")
    hit = (F.col("status") == "processing") & F.col("_at").isNotNull()
    return j.select(*[F.when(hit, "failed_retrying").otherwise(F.col(c)).alias(c) if c == "status"
                      else F.when(hit, F.col("_at") + F.expr(RATE_LIMIT_DELAY)).otherwise(F.col(c)).alias(c)
                      if c == "next_retry_at"
                      else F.when(hit, F.col("_at")).otherwise(F.col(c)).alias(c) if c == "updated_at"
                      else F.col(c) for c in SNAPSHOT_COLS])


# ------------------------------------------------------------------------ sweeps
def sweep_retries(snapshot: DataFrame, as_of: _dt.datetime) -> tuple[DataFrame, DataFrame]:
    """M8: due retries -> pending, plus an outbox 'NotificationRetry' row each."""
    now = ntz_lit(as_of)
    due = (F.col("status") == "failed_retrying") & (F.col("next_retry_at") <= now)
    new = snapshot.select(*[F.when(due, F.lit("pending")).otherwise(F.col(c)).alias(c) if c == "status"
                            else F.when(due, now).otherwise(F.col(c)).alias(c) if c == "updated_at"
                            else F.col(c) for c in SNAPSHOT_COLS])
    out = snapshot.where(due).select(
        F.concat(F.lit("r-"), F.col("id")).alias("id"), F.col("id").alias("aggregate_id"),
        F.lit("NotificationRetry").alias("event_type"), payload_json().alias("payload"),
        F.lit("pending").alias("status"), now.alias("created_at"))
    return new, out


def sweep_zombies(snapshot: DataFrame, as_of: _dt.datetime,
                  max_retries: int = MAX_RETRIES) -> tuple[DataFrame, DataFrame]:
    """M9: stuck processing rows -> pending with retry_count+1 and an outbox row, or
    failed_permanently when the retries are spent (no outbox, no DLQ)."""
    now = ntz_lit(as_of)
    z = zombie(as_of)
    again = z & (F.col("retry_count") < max_retries)
    dead = z & ~(F.col("retry_count") < max_retries)
    new = snapshot.select(*[
        F.when(again, "pending").when(dead, "failed_permanently").otherwise(F.col(c)).alias(c)
        if c == "status" else
        F.when(again, F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == "retry_count" else
        F.when(z, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else
        F.col(c) for c in SNAPSHOT_COLS])
    out = snapshot.where(again).select(
        F.concat(F.lit("z-"), F.col("id")).alias("id"), F.col("id").alias("aggregate_id"),
        F.lit("NotificationCreated").alias("event_type"), payload_json().alias("payload"),
        F.lit("pending").alias("status"), now.alias("created_at"))
    return new, out


def dual_write(valid_requests: DataFrame, out_dir: str, batch_id: Column | None = None, version: str = "batch") -> bool:
    """S8 batch form: one admitted frame -> the notifications rows and their outbox rows, from the
    same persisted data as one commit (both or none; a rerun of a committed ``version`` writes
    nothing).  Read the tables with ``sources.commits.committed``."""
    from pyspark import StorageLevel
    from missive.sources.commits import commit_tables
    rows, _ = apply_create(valid_requests, batch_id)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return commit_tables(out_dir, version, {"notifications": rows, "outbox": outbox_rows(rows)})
    finally:
        rows.unpersist()
