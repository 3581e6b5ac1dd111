"""Limiters over rows out of order: the verdicts of the batch operators."""

import random

import pytest

from missive.operators import limits as L
from missive.sources import derived as D
from missive.streaming import jobs as X
from missive.streaming import ordered as O
from tables_dir import SF_SMALL

LAST = 10**9


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """600 requests of five hours, each up to 40 minutes late, in ten files (one per micro-batch),
    and one much later row per file's end that moves the watermark past them all."""
    import datetime as dt
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c"]), t0 + dt.timedelta(milliseconds=rnd.randrange(5 * 3_600_000)), rnd.randint(1, 4)) for i in range(600)]
    rows += [(600 + i, "a", t0 + dt.timedelta(hours=2), 1) for i in range(5)]            # ties in time
    rows.sort(key=lambda r: r[2] + dt.timedelta(minutes=rnd.uniform(0, 40)))
    rows.append((LAST, "z", t0 + dt.timedelta(days=2), 1))
    schema = "req_id long, key string, ts timestamp_ntz, weight int"
    src = str(tmp_path_factory.mktemp("ordered") / "reqs")
    step = -(-len(rows) // 10)
    for k in range(10):
        spark.createDataFrame(rows[k * step:(k + 1) * step], schema).coalesce(1).write.mode("append").parquet(src)
    assert any(a[2] > b[2] for a, b in zip(rows[step - 1::step], rows[step::step]))
    return src, schema


def run(spark, shuffled, limiter, weight, tmp_path):
    src, schema = shuffled
    reqs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")          # fixed in the checkpoint at the start
    with O.map_state(spark):
        q = O.ordered_limit_stream(reqs, "key", "ts", "req_id", weight, limiter, 600_000, "1 hour").writeStream.format("parquet").option(
            "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r["req_id"] for r in out}) == len(out)
    return {r["req_id"]: tuple(r[c] for c, _ in limiter.extra) for r in out}, q


def test_sliding_log_of_shuffled_rows_over_ten_micro_batches(spark, shuffled, tmp_path):
    got, q = run(spark, shuffled, O.SlidingLog(4, 900_000), None, tmp_path)
    batch = L.limit_sliding(spark.read.parquet(shuffled[0]), "key", "ts", "req_id", 4, 900_000)
    want = {r["req_id"]: (r["allowed"],) for r in batch.collect() if r["req_id"] != LAST}
    assert got == want and {a for a, in got.values()} == {True, False}
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 10


def test_token_bucket_of_shuffled_rows_over_ten_micro_batches(spark, shuffled, tmp_path):
    got, _ = run(spark, shuffled, O.TokenBucket(10, 1 / 60), "weight", tmp_path)
    batch = L.limit_token_bucket(spark.read.parquet(shuffled[0]), "key", "ts", "req_id", "weight", 10, 1 / 60)
    want = {r["req_id"]: (r["allowed"], round(r["tokens_left"], 6)) for r in batch.collect() if r["req_id"] != LAST}
    assert {k: (a, round(t, 6)) for k, (a, t) in got.items()} == want and {a for a, _ in got.values()} == {True, False}


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(O.PROVIDER, None)
    with O.map_state(spark):
        assert spark.conf.get(O.PROVIDER) == O.ROCKS_DB
    assert spark.conf.get(O.PROVIDER, None) == before


def test_empty_input_gives_no_rows(spark, tmp_path):
    src = str(tmp_path / "none")
    D.limiter_requests(spark, SF_SMALL).where("false").write.parquet(src)
    reqs = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    with O.map_state(spark):
        out = X.run_to_parquet(O.ordered_limit_stream(reqs, "key", "ts", "req_id", None, O.SlidingLog(1, 1000)), "t_none")
    assert spark.read.schema("req_id long, key string, allowed boolean").parquet(out).count() == 0
