"""Message disposition (D4): what the worker does with each consumed message.

First match of: unparsable -> dlq; empty id -> skip; live cancel flag -> skip; lock not
taken and row missing -> skip; not taken and failed_permanently -> dlq again; not taken
-> skip; channel limiter refuses -> retry in 10 s; breaker open or retriable answer ->
failure rule (retry with backoff, or permanent + dlq); 2xx -> delivered; else permanent
+ dlq.  Composed from J1 (cancel as-of), J4 (status lookup), L2 (sliding limiter over the
locked messages), B1 + J8 (breaker replay over webhook calls, as-of lookup) and P22.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.operators import breaker as B
from missive.operators import joins as J
from missive.operators import limits as L
from missive.operators.projections import classify_http
from missive.operators.transitions import MAX_RETRIES
from missive.session import ensure_checkpoint_dir, materialize

# Fixed values of the worker (limits per channel, breaker settings).
CHANNEL_LIMIT, CHANNEL_WINDOW_MS = 100, 1000
BREAKER_NAME = "webhook_main"
DLQ_TOPIC = "notifications-dlq"
BREAKER_MAX, BREAKER_WINDOW_S, BREAKER_OPEN_S = 10, 10, 30


def webhook_replay(attempts: DataFrame, trips_only: bool = False, keep: list | None = None) -> DataFrame:
    """B1 over all webhook calls (one breaker for the whole worker): verdict per call."""
    calls = attempts.select(
        F.lit(BREAKER_NAME).alias("name"), F.col("attempt_ts").alias("ts"),
        (classify_http("http_status") != "retriable").alias("ok"),
        F.struct("id", "attempt_no", F.coalesce("http_status", F.lit(-1)).alias("h"), "message_id",
                 "latency_s").alias("call_id"))
    return B.breaker_replay(calls, max_failures=BREAKER_MAX, window_s=BREAKER_WINDOW_S,
                            open_s=BREAKER_OPEN_S, trips_only=trips_only, keep=keep)


def webhook_breaker_trips(attempts: DataFrame) -> DataFrame:
    return webhook_replay(attempts, trips_only=True, keep=["name", "ts"]).select("name", "ts")


def first_messages(m: DataFrame) -> DataFrame:
    """nid, ``_f``: the first (ts, msg_id) of each notification that several rows of ``m`` name.

    Rows are counted first, which needs no order of texts; only repeated ids are compared."""
    repeated = m.groupBy("nid").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("nid")
    return m.join(repeated, "nid", "left_semi").groupBy("nid").agg(F.min(F.struct("ts", "msg_id")).alias("_f"))


def latest_answer(attempts: DataFrame) -> DataFrame:
    """nid, outcome: class of the http status of the latest attempt (``latest_outcome``'s order).

    The status is all that is asked for, and attempts of equal time, number and status have
    the same one: these three, as one whole number (33 bits for the number, 33 for the status,
    a missing value below all, no status at the place of -1), are compared in a hash aggregate."""
    dec = lambda c, digits: c.cast(f"decimal({digits},0)")
    us = F.coalesce(F.unix_micros(F.col("attempt_ts").cast("timestamp")), F.lit(-2 ** 60))
    number = F.coalesce(F.col("attempt_no").cast("bigint"), F.lit(-2 ** 31 - 1)) + F.lit(2 ** 31 + 1)
    status = F.coalesce(F.col("http_status").cast("bigint") * 2, F.lit(-1)) + F.lit(2 ** 32)
    place = (dec(us, 19) * dec(F.lit(str(2 ** 66)), 20)) + (dec(number, 10) * dec(F.lit(str(2 ** 33)), 10)) + dec(status, 10)
    return attempts.groupBy(F.col("id").alias("nid")).agg(F.max_by("http_status", place).alias("_status")).select(
        "nid", classify_http("_status").alias("outcome"))


def disposition(messages: DataFrame, snapshot: DataFrame, cancels: DataFrame,
                attempts: DataFrame, max_retries: int = MAX_RETRIES,
                channel_limit: int = CHANNEL_LIMIT, trips: DataFrame | None = None) -> DataFrame:
    """``messages``: (msg_id, ts, payload), or (msg_id, ts, poison, nid, channel) where the caller
    has the payloads parsed.  Returns one row per message with
    ``disposition`` and the notification id it names.  ``trips``: the trips of
    ``webhook_breaker_trips`` where the caller has them at hand; ``attempts`` may then be
    the latest of each id alone."""
    if "payload" in messages.columns:
        m = J.parse_payload(messages.select("msg_id", "ts", "payload"), "payload", {"nid": "id", "channel": "channel"})
    else:
        m = messages.select("msg_id", "ts", "poison", "nid", "channel")
    # Live cancel flag (a cancel within 24 h before the message)
    m = J.any_before(m, cancels.select(F.col("id").alias("nid"), F.col("ts").alias("cancel_ts")), "nid", "ts", "cancel_ts",
                     J.CANCEL_TTL_SECONDS, "canceled")
    # parsed once and written once: read by the search for first messages and by the main branch
    m = materialize(m.withColumn("_reach", ~F.col("poison") & ~F.col("canceled")), "disposition_messages")
    # what names no notification is settled here and takes no part in the joins by id
    unnamed = m.where("nid = ''").select(
        "msg_id", "nid", F.when(F.col("poison"), "dlq_unparsable").otherwise("skip_empty_id").alias("disposition"))
    m = m.where("nid <> ''")
    # The first message of an id takes an eligible row; missing rows are seen
    #      (first among the messages that reach the lock); the webhook's answer for the row
    snap = snapshot.select(F.col("id").alias("nid"), "status", "next_retry_at", "retry_count")
    m = (m.join(snap, "nid", "left").join(latest_answer(attempts), "nid", "left")
          .join(first_messages(m.where("_reach")), "nid", "left"))
    eligible = (F.col("status") == "pending") | \
               ((F.col("status") == "failed_retrying") & (F.col("next_retry_at") <= F.col("ts")))
    first = F.col("_f").isNull() | (F.struct("ts", "msg_id") == F.col("_f"))
    m = m.withColumn("taken", F.coalesce(F.col("_reach") & first & eligible, F.lit(False)))
    # each row's disposition but for the limiter and the breaker, and the one if the call fails
    failure = F.when(F.col("retry_count") + 1 < max_retries, "retry").otherwise("dlq_permanent")
    settled = (F.when(F.col("poison"), "dlq_unparsable")
               .when(F.col("canceled"), "skip_canceled")
               .when(~F.col("taken") & F.col("status").isNull(), "skip_missing")
               .when(~F.col("taken") & (F.col("status") == "failed_permanently"), "dlq_again")
               .when(~F.col("taken"), "skip_not_taken"))
    called = (F.when(F.col("outcome").isNull() | (F.col("outcome") == "retriable"), failure)
              .when(F.col("outcome") == "delivered", "delivered")
              .otherwise("dlq_permanent"))
    # the frame feeds the limiter branch and the main branch: written once
    m = materialize(m.select("msg_id", "ts", "nid", "taken", F.when(F.col("taken"), F.col("channel")).alias("channel"),
                             settled.alias("settled"), F.when(F.col("taken"), failure).alias("failed"),
                             F.when(F.col("taken"), called).alias("called")), "disposition_locked")
    # L2 over the taken messages only (refused ones are not recorded)
    taken = m.where("taken").select("msg_id", "channel", "ts")
    lim = L.limit_sliding(taken, "channel", "ts", "msg_id", channel_limit, CHANNEL_WINDOW_MS) \
           .select("msg_id", "allowed")
    m = m.drop("channel", "taken").join(lim, "msg_id", "left")
    # Breaker open at the message time (a few rows, written so that no branch replays the calls again)
    trips = materialize(webhook_breaker_trips(attempts), "webhook_trips") if trips is None else trips
    m = B.breaker_open_at(m.withColumn("name", F.lit(BREAKER_NAME)), trips, open_s=BREAKER_OPEN_S)
    disp = (F.when(F.col("settled").isNotNull(), F.col("settled"))
            .when(~F.col("allowed"), "retry_limited")
            .when(F.col("breaker_open"), F.col("failed"))
            .otherwise(F.col("called")))
    return m.select("msg_id", "nid", disp.alias("disposition")).unionByName(unnamed)


def dead_letters(decided: DataFrame, messages: DataFrame) -> DataFrame:
    """msg_id, reason, topic, key, value of the messages that ``disposition`` sends to the
    dead letter topic; ``messages``: (msg_id, payload).  Value: the message as it came; key:
    the notification id, none when the payload did not parse."""
    dead = decided.where(F.col("disposition").startswith("dlq"))
    key = F.when(F.col("disposition") != "dlq_unparsable", F.encode("nid", "UTF-8"))
    return dead.join(messages.select("msg_id", "payload"), "msg_id").select(
        "msg_id", F.col("disposition").alias("reason"), F.lit(DLQ_TOPIC).alias("topic"), key.alias("key"),
        F.encode("payload", "UTF-8").alias("value"))


def write_dead_letters(decided: DataFrame, messages: DataFrame) -> str:
    """``dead_letters`` as files under the shared folder, one folder per topic."""
    path = f"{ensure_checkpoint_dir(decided.sparkSession).rstrip('/')}/tables/dead-letters-{uuid.uuid4().hex[:12]}"
    dead_letters(decided, messages).write.partitionBy("topic").parquet(path)
    return path
