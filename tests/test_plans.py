"""Ordering helpers, admission rounds, transitions and the registered queries."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from missive.operators import ordering as R
from missive.operators.admission import batch_atomic_admission
from missive.operators import transitions as M
from tables_dir import SF_SMALL


def test_global_row_number_matches_window(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 50)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = R.global_row_number(df, ["v", "id"], keys=["k"], num_partitions=7)
    w = Window.partitionBy("k").orderBy("v", "id")
    want = df.withColumn("rn", F.row_number().over(w))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_global_row_number_null_keys(spark):
    rows = [(i, None if i % 3 == 0 else "x", None if i % 5 == 0 else i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, j long")
    got = R.global_row_number(df, ["id"], keys=["k", "j"], num_partitions=4)
    w = Window.partitionBy("k", "j").orderBy("id")
    want = df.withColumn("rn", F.row_number().over(w))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_no_local_checkpoint_folder_on_a_cluster():
    import pytest
    from missive.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_global_row_number_descending(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), rnd.randint(0, 30)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = R.global_row_number(df, ["v", "id"], keys=["k"], num_partitions=5, descending=True)
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("id").desc())
    want = df.withColumn("rn", F.row_number().over(w))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_binned_running_matches_window(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.randint(-5, 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = R.binned_running(df, ["k"], [F.col("id")], F.floor(F.col("id") / 97), F.col("v"), "sum", "s")
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("v").over(w))
    assert sorted(got.select("id", "s").collect()) == sorted(want.select("id", "s").collect())


def test_batch_atomic_admission_chain(spark):
    # batch 1 and 2 share key x; 2 and 3 share y; 1 is refused (in-batch duplicate z),
    # so 2 takes x and y, and 3 is refused; 4 is independent
    mem = [(1, "x"), (1, "z"), (1, "z"), (2, "x"), (2, "y"), (3, "y"), (4, "w")]
    df = spark.createDataFrame([(b, k, b) for b, k in mem], "batch_no long, key string, batch_order long")
    got = {r["batch_no"]: r["admitted"] for r in batch_atomic_admission(df).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}
    # refusing batch 2 up front (say, an invalid row) frees y for batch 3
    up = spark.createDataFrame([(2,)], "batch_no long")
    got = {r["batch_no"]: r["admitted"] for r in batch_atomic_admission(df, refused_upfront=up).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}


def _snap(spark, rows):
    return spark.createDataFrame(rows, "id string, status string, next_retry_at timestamp_ntz, retry_count int")


def test_cancel_matrix(spark):
    import datetime as dt
    snap = _snap(spark, [(s, s, None, 0) for s in ("pending", "failed_retrying", "delivered",
                                                    "failed_permanently", "canceled", "processing")])
    for c in M.SNAPSHOT_COLS:
        if c not in snap.columns:
            snap = snap.withColumn(c, F.lit(None).cast("string" if c not in ("created_at", "updated_at")
                                                        else "timestamp_ntz"))
    reqs = spark.createDataFrame([(i, s) for i, s in enumerate(["pending", "failed_retrying", "delivered",
                                  "failed_permanently", "canceled", "processing", "missing", "pending"])],
                                 "req_id long, id string")
    _new, v = M.apply_cancel(snap, reqs, dt.datetime(2026, 1, 1))
    got = {r["req_id"]: (r["result"], r["current_status"]) for r in v.collect()}
    assert got == {0: ("canceled", ""), 1: ("canceled", ""), 2: ("refused", "delivered"),
                   3: ("refused", "failed_permanently"), 4: ("refused", "canceled"),
                   5: ("refused", "processing"), 6: ("not_found", ""), 7: ("refused", "canceled")}


def test_failure_rule(spark):
    r = M.outcome_rules(F.lit("processing"), F.lit(2), F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz"),
                        F.lit(None).cast("timestamp_ntz"), F.lit("retriable"), F.lit(""),
                        F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), 3)
    row = spark.range(1).select(r["status"].alias("s"), r["retry_count"].alias("c"), r["dlq"].alias("d")).first()
    assert (row["s"], row["c"], row["d"]) == ("failed_permanently", 3, True)


def test_entry_and_queries_small(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "disposition" in df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 120


def test_oracle_agreement_small(spark):
    """A sample of registered queries against their DuckDB oracle on sf0.001."""
    import duckdb
    import check_oracle as C
    from missive.plans import registry
    from missive.sources.tables import TABLES, table_path
    registry.load_all()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    for k in ["validate_first_error", "list_envelope", "cancel_flag_join", "outcome_apply_join",
              "limit_sliding", "breaker_replay", "lifecycle_fold", "disposition", "page_number",
              "commit_watermark", "audit_legal_moves", "batch_atomic_admission"]:
        df = registry.QUERIES[k](spark, SF_SMALL)
        s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
        res = con.execute(registry.ORACLE[k])
        o_cols, o_rows = [d[0] for d in res.description], res.fetchall()
        assert C.digest(s_cols, s_rows)[0] == C.digest(o_cols, o_rows)[0], k
