"""Streaming jobs: results equal the batch operators on the same input."""

from tables_dir import SF_SMALL
from missive.operators import joins as J
from missive.operators import limits as L
from missive.sources import derived as D
from missive.sources.tables import streaming_tables
from missive.streaming import jobs as X


def test_stream_limits_equal_batch(spark):
    with streaming_tables("events"):
        reqs = D.limiter_requests(spark, SF_SMALL)
    out = X.run_to_parquet(X.sliding_limit_stream(reqs, "key", "ts", "req_id", 2, 900_000), "t_limits")
    got = {r["req_id"]: r["allowed"] for r in spark.read.parquet(out).collect()}
    want = {r["req_id"]: r["allowed"] for r in
            L.limit_sliding(D.limiter_requests(spark, SF_SMALL), "key", "ts", "req_id", 2, 900_000).collect()}
    assert got == want


def test_stream_stream_cancel_join_settled_part(spark):
    """The stream-stream interval join emits a message once the watermark has passed its
    interval; what it emits must be exactly the batch answer restricted to those rows."""
    with streaming_tables("events"):
        msgs = D.messages(spark, SF_SMALL)
        cancels = D.cancels(spark, SF_SMALL)
    joined = X.cancel_join_stream_stream(msgs, cancels)
    out = X.run_to_parquet(joined, "t_cancel")
    got = {r["msg_id"] for r in spark.read.parquet(out).collect()}
    want = {r["msg_id"] for r in J.cancel_flag_join(D.messages(spark, SF_SMALL), D.cancels(spark, SF_SMALL)).collect()}
    assert got and got <= want


def test_stream_dlq_split_covers_every_row(spark):
    with streaming_tables("orders"):
        box = D.outbox(spark, SF_SMALL)
    out = X.dlq_split(box, "t_dlq")
    dlq = spark.read.parquet(f"{out}/dlq").count()
    topics = spark.read.parquet(f"{out}/topics").count()
    assert dlq + topics == D.outbox(spark, SF_SMALL).count() and dlq > 0


def test_bounded_admission_keeps_one_row_per_key(spark):
    from pyspark.sql import functions as F
    from missive.operators import validate as V
    with streaming_tables("events"):
        reqs = D.requests(spark, SF_SMALL)
    out = X.run_to_parquet(X.admission_bounded(reqs, "24 hours").drop("error"), "t_bounded")
    got = spark.read.parquet(out)
    valid = V.validate_requests(D.requests(spark, SF_SMALL)).where(F.col("error").isNull())
    assert got.count() == valid.select("idempotency_key").distinct().count()
    assert got.groupBy("idempotency_key").count().where("count > 1").count() == 0


def test_latest_per_key_keeps_the_last_micro_batch(spark, tmp_path):
    """What ``_write_batch`` wrote in two batches: a changed key has its last value."""
    path = str(tmp_path / "out")
    X._write_batch(spark.createDataFrame([("a", 9), ("b", 1)], "k string, value long"), path, 0)
    X._write_batch(spark.createDataFrame([("a", 2)], "k string, value long"), path, 1)
    got = X.latest_per_key(spark, path, ["k"])
    assert got.columns == ["k", "value"] and sorted(tuple(r) for r in got.collect()) == [("a", 2), ("b", 1)]


def test_stream_metrics_equals_batch_counts(spark):
    from pyspark.sql import functions as F
    from missive.plans.streams import stream_metrics
    got = sorted(tuple(r) for r in stream_metrics(spark, SF_SMALL).collect())
    log = D.api_log(spark, SF_SMALL).groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz"), "method", "route").count()
    assert got and got == sorted(tuple(r) for r in log.collect())


def test_stream_token_bucket_equals_batch_over_micro_batches(spark, tmp_path):
    """Three files read one per micro-batch: the bucket's state is carried between them."""
    rows = D.limiter_requests(spark, SF_SMALL).orderBy("ts").limit(600).collect()
    schema = D.limiter_requests(spark, SF_SMALL).schema
    src = str(tmp_path / "reqs")
    for k in range(3):
        spark.createDataFrame(rows[200 * k:200 * k + 200], schema).coalesce(1).write.mode("append").parquet(src)
    reqs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = X.run_to_parquet(X.token_bucket_stream(reqs, "key", "ts", "req_id", "weight", 10, 1 / 36_000, "3650 days"), "t_bucket")
    got = {r["req_id"]: (r["allowed"], round(r["tokens_left"], 6)) for r in spark.read.parquet(out).collect()}
    batch = L.limit_token_bucket(spark.read.parquet(src), "key", "ts", "req_id", "weight", 10, 1 / 36_000)
    want = {r["req_id"]: (r["allowed"], round(r["tokens_left"], 6)) for r in batch.collect()}
    assert got == want and len(got) == 600 and {a for a, _ in got.values()} == {True, False}


def test_lifecycle_state_holds_live_rows_only(spark, tmp_path):
    """Two files, one per micro-batch: rows that reach a terminal status leave the state."""
    import datetime as dt
    from missive.operators import lifecycle as LC
    t0 = dt.datetime(2024, 1, 1)
    sec = lambda x: t0 + dt.timedelta(seconds=x)
    made = spark.createDataFrame([(i, t0) for i in "abc"], "id string, created_at timestamp_ntz")
    none = spark.createDataFrame([], "id string, attempt_ts timestamp_ntz, http_status int, message_id string, attempt_no int, latency_s double")
    locks = spark.createDataFrame([(i, sec(1)) for i in "abc"], "id string, ts timestamp_ntz")
    done = spark.createDataFrame([("a", sec(2), 200, "m"), ("b", sec(2), 400, "")], "id string, ts timestamp_ntz, http_status int, message_id string")
    log = LC.event_log(made, none, none.selectExpr("id", "attempt_ts AS ts"), locks=locks, outcomes=done)
    src = str(tmp_path / "log")
    log.where("kind <> 'outcome'").coalesce(1).write.parquet(src)
    log.where("kind = 'outcome'").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = X.lifecycle_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert rows[0] == 3 and rows[-1] == 1
    last = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("moves").collect():
        last[r["id"]] = r["status"]
    assert last == {"a": "delivered", "b": "failed_permanently", "c": "processing"}
