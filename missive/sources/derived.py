"""Delivery-domain inputs derived from the driver's tables.

Every view is a pure projection / filter of one source table, so its size grows with
the scale factor and it costs one narrow scan.  The DuckDB oracle builds the same
views in SQL (``missive.plans.oracle_views``); both must stay in step.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.sources.tables import read_table

# Fixed values of the derived fixtures (shared with the oracle views).
AS_OF = _dt.datetime(1998, 6, 1, 0, 0, 0)          # "now" for sweeps, lock and backoff
STATUSES = ["pending", "processing", "delivered", "failed_retrying",
            "failed_permanently", "canceled"]
TRANSITION_STATUSES = ["pending", "processing", "failed_retrying", "pending",
                       "delivered", "failed_permanently"]
HTTP_BY_FLAGS = {"AF": 200, "AO": 202, "NF": 500, "NO": 429, "RF": 400, "RO": 408}


def s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def uuid_from(n: Column, first: str = "0") -> Column:
    """Deterministic canonical UUID text whose last group is the zero-padded number."""
    return F.concat(F.lit(first + "0000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))


def _pick(index: Column, values: list) -> Column:
    out = None
    for i, v in enumerate(values):
        out = (F.when(index == i, F.lit(v)) if out is None else out.when(index == i, F.lit(v)))
    return out


# --------------------------------------------------------------------------- requests
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API requests (one per event): raw, un-normalised strings."""
    e = read_table(spark, sf_dir, "events")
    eid, et, uid = F.col("event_id"), F.col("event_type"), F.col("user_id")
    key_n = F.when(eid % 50 == 49, eid - 1).otherwise(eid)
    channel = (F.when(et == "error", " SMS ").when(et == "click", "push")
               .when(et == "view", "Push").when(et == "signup", "email")
               .otherwise(F.when(eid % 3 == 0, "fax").otherwise("EMAIL")))
    recipient = (F.when(eid % 41 == 0, "")
                 .when(et == "error", F.when(eid % 7 == 0, "abc")
                       .otherwise(F.concat(F.lit("+90555"), F.lpad(s(uid), 7, "0"))))
                 .when(et.isin("click", "view"), F.concat(F.lit("device-"), s(uid)))
                 .otherwise(F.when(eid % 13 == 0, "not-an-email")
                            .otherwise(F.concat(F.lit("user_"), s(uid), F.lit("@example.com")))))
    priority = (F.when(eid % 5 == 0, " HIGH ").when(eid % 5 == 1, "normal")
                .when(eid % 5 == 2, "low").when(eid % 5 == 3, "")
                .otherwise(F.when(eid % 25 == 4, "critical").otherwise("high")))
    return e.select(
        eid.alias("seq"),
        F.col("ts").alias("arrival_ts"),
        F.floor(eid / 20).cast("bigint").alias("batch_no"),
        F.concat(F.lit("k-"), s(key_n)).alias("idempotency_key"),
        recipient.alias("recipient"),
        channel.alias("channel"),
        F.expr("repeat('x', cast(floor(value * 2) as int))").alias("content"),
        priority.alias("priority"),
        F.concat(F.lit("10.0."), s(uid % 4), F.lit("."), s(uid), F.lit(", 10.9.9.9")).alias("xff"),
        F.when(eid % 3 == 0, F.concat(F.lit("req-"), s(eid))).alias("correlation_id"),
    )


def _json_str(name: str, c: Column) -> Column:
    return F.concat(F.lit(f'"{name}":"'), c, F.lit('"'))


def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON request bodies with the failure kinds the strict decoder must refuse."""
    r = requests(spark, sf_dir)
    seq = F.col("seq")
    head = F.concat_ws(",", _json_str("idempotency_key", F.col("idempotency_key")),
                       _json_str("recipient", F.col("recipient")),
                       _json_str("channel", F.col("channel")),
                       _json_str("content", F.col("content")))
    full = F.concat(F.lit("{"), head, F.lit(","), _json_str("priority", F.col("priority")), F.lit("}"))
    huge = F.concat(F.lit('{"content":"'), F.expr("repeat('y', 600000)"), F.lit('",'), head, F.lit("}"))
    body = (F.when((seq % 9973).isin(4000, 4001), huge)
            .when(seq % 29 == 5, F.concat(F.lit('{"Channel":"fax",'), head, F.lit("}")))
            .when(seq % 29 == 6, F.concat(F.lit("{"), head, F.lit(',"CHANNEL":"sms"}')))
            .when(seq % 37 == 0, F.lit(""))
            .when(seq % 31 == 0, F.concat(F.lit('{"idempotency_key":"'), F.col("idempotency_key"),
                                          F.lit('","recipient":')))
            .when(seq % 23 == 0, F.concat(F.lit("{"), head, F.lit(',"priority":5}')))
            .when(seq % 11 == 0, F.concat(F.lit("{"), head, F.lit(","),
                                          _json_str("priority", F.col("priority")),
                                          F.lit(',"extra":"1"}')))
            .when(seq % 7 == 3, F.concat(F.lit("{"), head, F.lit("}")))
            .when(seq % 43 == 0, F.concat(F.lit("{"), head, F.lit(',"priority":null}')))
            .otherwise(full))
    return r.select("seq", "batch_no", "arrival_ts", body.alias("body"), "xff")


def batch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array body per batch of 20 requests (every 13th batch is sent empty).

    Every third batch holds well-formed items of its own; of these some repeat the keys of
    the batch three before, or hold a key twice, or an item that validation refuses."""
    r = request_json(spark, sf_dir)
    seq, no = F.col("seq"), F.col("batch_no")
    key_n = F.when(no % 9 == 6, seq - 60).when(seq % 50 == 49, seq - 1).otherwise(seq)
    item = F.concat(F.lit("{"), F.concat_ws(
        ",", _json_str("idempotency_key", F.concat(F.lit("g-"), s(key_n))),
        _json_str("recipient", F.concat(F.lit("user_"), s(seq), F.lit("@example.com"))),
        _json_str("channel", F.when((no % 15 == 12) & (seq % 20 == 7), "fax").otherwise("email")),
        _json_str("content", F.concat(F.lit("batch "), s(no))), _json_str("priority", F.lit("high"))), F.lit("}"))
    good = no % 3 == 0
    r = r.where(good | ((F.col("body") != "") & (seq % 31 != 0))).withColumn("body", F.when(good, item).otherwise(F.col("body")))
    g = r.groupBy("batch_no").agg(
        F.min("arrival_ts").alias("arrival_ts"), F.min_by("xff", "seq").alias("xff"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))),
                                 lambda x: x["body"]), ",").alias("items"))
    body = F.when(F.col("batch_no") % 13 == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("["), F.col("items"), F.lit("]")))
    return g.select("batch_no", "arrival_ts", body.alias("body"), "xff")


# ---------------------------------------------------------------------- notifications
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of the notifications table (one row per order)."""
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = _pick((k * 7 + c) % 6, STATUSES)
    pr = F.col("o_orderpriority")
    return o.select(
        uuid_from(k).alias("id"),
        uuid_from(c, "1").alias("batch_id"),
        F.concat(F.lit("k-"), s(k * 3)).alias("idempotency_key"),
        F.concat(F.lit("user_"), s(c), F.lit("@example.com")).alias("recipient"),
        _pick(k % 3, ["sms", "email", "push"]).alias("channel"),
        F.concat(F.lit("order "), s(k)).alias("content"),
        F.when(pr.isin("1-URGENT", "2-HIGH"), "high").when(pr == "5-LOW", "low")
         .otherwise("normal").alias("priority"),
        status.alias("status"),
        F.when(status == "delivered", F.concat(F.lit("ext-"), s(k))).alias("external_id"),
        (k % 4).cast("int").alias("retry_count"),
        F.when(status == "failed_retrying", F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS"))
         .alias("next_retry_at"),
        F.when(k % 2 == 0, F.concat(F.lit("c-"), s(k))).alias("correlation_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery attempts (webhook outcomes); a null status is a transport error."""
    li = read_table(spark, sf_dir, "lineitem")
    flags = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    status = None
    for f, code in HTTP_BY_FLAGS.items():
        status = F.when(flags == f, code) if status is None else status.when(flags == f, code)
    status = F.when(F.col("l_suppkey") % 97 == 0, F.lit(None).cast("int")).otherwise(status)
    return li.select(
        uuid_from(F.col("l_orderkey")).alias("id"),
        F.col("l_linenumber").alias("attempt_no"),
        F.col("l_shipdate").alias("attempt_ts"),
        status.cast("int").alias("http_status"),
        F.when(F.col("l_linenumber") % 2 == 1,
               F.concat(F.lit("m-"), s("l_orderkey"), F.lit("-"), s("l_linenumber")))
         .otherwise(F.lit("")).alias("message_id"),
        (F.col("l_quantity") / 10.0).alias("latency_s"),
    )


def worker_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(locks, refusals, outcomes) of the worker: every attempt locks its row; by its latency
    (tenths of a second) the limiter refuses it (multiples of 11), the worker dies with it and
    leaves the lock (multiples of 13), or its outcome comes that much later."""
    a = attempts(spark, sf_dir)
    tenths = F.round(F.col("latency_s") * 10).cast("int")
    later = F.col("attempt_ts") + F.make_dt_interval(secs=(tenths / 10).cast("decimal(18,6)"))
    return (a.select("id", F.col("attempt_ts").alias("ts")),
            a.where(tenths % 11 == 0).select("id", F.col("attempt_ts").alias("ts")),
            a.where((tenths % 11 != 0) & (tenths % 13 != 0)).select("id", later.alias("ts"), "http_status", "message_id"))


def offset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumed offsets per topic partition with out-of-order completion."""
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    done = eid % 997 != 0
    return e.select(
        _pick(eid % 3, ["high", "normal", "low"]).alias("topic"),
        (F.floor(eid / 3) % 3).cast("int").alias("partition"),
        F.floor(eid / 9).cast("bigint").alias("offset"),
        F.col("ts").alias("tracked_at"),
        F.when(done, eid + F.floor(F.col("value"))).cast("bigint").alias("done_rank"),
        F.when(done, F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value")).cast("int")))
         .alias("done_at"),
        F.when(eid % 499 != 0, F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") / 4).cast("int")))
         .alias("picked_at"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook calls per breaker name."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("call_id"),
                    F.concat(F.lit("hook_"), s(F.col("user_id") % 4)).alias("name"),
                    "ts", (F.col("event_type") != "error").alias("ok"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").where(F.col("event_type") != "signup")
    return e.select(F.col("event_id").alias("msg_id"), F.col("user_id").alias("id"), "ts")


def cancels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return e.select(F.col("user_id").alias("id"), F.col("ts").alias("cancel_ts"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status transition log (with deliberate invariant violations)."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"),
                    _pick((F.col("conv_id") + F.col("turn")) % 6, TRANSITION_STATUSES).alias("status"),
                    F.col("turn").cast("int").alias("retry_count"))


def api_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    et, eid = F.col("event_type"), F.col("event_id")
    return e.select(
        F.when(et == "view", "GET").when(et == "error", "DELETE").otherwise("POST").alias("method"),
        F.when(et == "view", "/notifications").when(et == "error", "/notifications/{id}")
         .when(et == "purchase", "/notifications/batch").otherwise("/notifications").alias("route"),
        F.when(eid % 17 == 0, "429").when(eid % 19 == 0, "409").otherwise("202").alias("status_code"),
        (F.col("value") / 100.0).alias("latency_s"),
        "ts",
    )


def doc_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose content is a whole document text (multi-byte, long)."""
    d = read_table(spark, sf_dir, "documents")
    did = F.col("doc_id")
    ch = _pick(did % 3, ["sms", "email", "push"])
    recipient = (F.when(did % 3 == 0, F.concat(F.lit("+90555"), F.lpad(s(did), 7, "0")))
                 .when(did % 3 == 1, F.concat(F.lit("doc"), s(did), F.lit("@example.com")))
                 .otherwise(F.concat(F.lit("device-"), s(did))))
    return d.select(did.alias("seq"), F.concat(F.lit("d-"), s(did)).alias("idempotency_key"),
                    recipient.alias("recipient"), ch.alias("channel"),
                    F.col("text").alias("content"), F.lit("normal").alias("priority"))


def limiter_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limiter input: key = event type, millisecond time, weight 1..5."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("req_id"), F.col("event_type").alias("key"),
                    "ts", (1 + F.col("event_id") % 5).cast("int").alias("weight"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows written with each notification (some payloads are poison)."""
    n = notifications(spark, sf_dir)
    k = F.substring("id", 25, 12).cast("bigint")
    payload = F.to_json(F.struct("id", "correlation_id", "recipient", "channel", "content",
                                 "priority"), {"ignoreNullFields": "false"})
    field = F.element_at(F.array(*[F.lit(f) for f in ("id", "correlation_id", "recipient", "channel", "content", "priority")]),
                         (k % 6 + 1).cast("int"))
    unknown = F.concat(F.lit('{"id":"'), uuid_from(k, "9"), F.lit('","channel":"sms"}'))
    payload = (F.when(k % 101 == 0, F.concat(F.lit('{"'), field, F.lit('":5}'))).when(k % 103 == 0, F.lit("not json"))
               .when(k % 107 == 0, F.lit("null")).when(k % 109 == 0, unknown)
               .when(k % 113 == 0, F.concat(payload, F.lit(" junk"))).otherwise(payload))
    return n.select(
        uuid_from(k, "2").alias("id"),
        F.col("id").alias("aggregate_id"),
        F.when(F.col("status") == "failed_retrying", "NotificationRetry")
         .otherwise("NotificationCreated").alias("event_type"),
        payload.alias("payload"),
        F.when(F.col("status").isin("pending", "failed_retrying"), "pending")
         .otherwise("sent").alias("status"),
        F.col("created_at"),
    )


def cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancel API calls by notification id: two per id and unknown ids long after the
    messages (one per event), and calls three hours before a message (orders)."""
    e = read_table(spark, sf_dir, "events")
    o = read_table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 23 == 0)
    late = e.select(F.col("event_id").alias("req_id"),
                    uuid_from(F.floor(F.col("event_id") / 2) * 2).alias("id"), "ts")
    live = o.select((F.lit(10 ** 15) + F.col("o_orderkey")).cast("bigint").alias("req_id"),
                    uuid_from(F.col("o_orderkey")).alias("id"),
                    (F.col("o_orderdate").cast("timestamp_ntz") - F.expr("INTERVAL 3 HOURS")).alias("ts"))
    return late.unionByName(live)


def timed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook calls with a duration: end = start + floor(value) seconds (B3 input)."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("call_id"),
                    F.concat(F.lit("hook_"), s(F.col("user_id") % 4)).alias("name"),
                    "ts", (F.col("event_type") != "error").alias("ok"),
                    (F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("int"))).alias("end_ts"))
