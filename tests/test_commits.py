"""Two tables in one commit: both or none."""

import pytest
from pyspark.sql import functions as F

from missive.sources.commits import commit_tables, committed


def frames(spark, ids, fail=False):
    rows = spark.createDataFrame([(i, f"k-{i}") for i in ids], "id long, k string")
    box = rows.select(F.concat(F.lit("o-"), "id").alias("id"), F.col("id").alias("aggregate_id"))
    if fail:
        box = box.where(F.raise_error(F.lit("lost")).isNull())
    return {"notifications": rows, "outbox": box}


def ids(spark, base, table):
    df = committed(spark, base, table)
    return None if df is None else sorted(r["id"] for r in df.collect())


def test_a_failure_between_the_writes_shows_no_row(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(Exception, match="lost"):
        commit_tables(base, "batch-0", frames(spark, [1, 2], fail=True))
    assert ids(spark, base, "notifications") is None and ids(spark, base, "outbox") is None
    assert commit_tables(base, "batch-0", frames(spark, [1, 2]))
    assert ids(spark, base, "notifications") == [1, 2] and ids(spark, base, "outbox") == ["o-1", "o-2"]
    with pytest.raises(Exception, match="lost"):
        commit_tables(base, "batch-1", frames(spark, [3], fail=True))
    assert ids(spark, base, "notifications") == [1, 2]


def test_a_committed_batch_run_again_writes_nothing(spark, tmp_path):
    base = str(tmp_path / "t")
    assert commit_tables(base, "batch-0", frames(spark, [1]))
    assert not commit_tables(base, "batch-0", frames(spark, [1, 9]))
    assert commit_tables(base, "batch-1", frames(spark, []))
    assert ids(spark, base, "notifications") == [1] and ids(spark, base, "outbox") == ["o-1"]


def test_quantiles_of_merged_sketches_are_within_their_error(spark):
    import random
    from missive.operators.quantiles import BITS, merge, quantiles, sketch
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), d, int(rnd.lognormvariate(9, 4))) for d in range(5) for _ in range(400)]
    rows += [("a", 9, None), ("c", 0, 0), ("d", 0, 2**62 + 5)]
    df = spark.createDataFrame(rows, "k string, day int, v long")
    got = {r["k"]: r for r in quantiles(merge(sketch(df, ["k", "day"], "v"), ["k"]), ["k"], [1, 50, 95, 100]).collect()}
    assert set(got) == set("abcd")
    for k, r in got.items():
        vs = sorted(v for a, _d, v in rows if a == k and v is not None)
        assert r["n"] == len(vs)
        for p in (1, 50, 95, 100):
            exact = vs[-(-len(vs) * p // 100) - 1]
            assert abs(r[f"p{p}"] - exact) <= exact / 2 ** (BITS + 1)
