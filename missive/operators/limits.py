"""Rate limiters (L1-L5): fixed window, sliding log and token bucket replays."""

from __future__ import annotations

import collections

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missive.session import materialize


def epoch_second(ts: str):
    return F.expr(f"unix_micros(cast({ts} as timestamp)) div 1000000")


def fixed_window_rank(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """N-th request of its key within its epoch second (refused ones count too).

    A running count per (key, second) split into 10 ms bins (``binned_running``), so a
    key-second under a flood still spreads over up to 100 window partitions."""
    from missive.operators.ordering import binned_running
    d = df.withColumn("sec", epoch_second(ts))
    ms = F.expr(f"unix_millis(cast({ts} as timestamp))")
    r = binned_running(d, [key, "sec"], [F.col(ts), F.col(order)], F.floor(ms / 10), F.lit(1), "sum", "n")
    return r.withColumn("n", F.col("n").cast("bigint"))


def limit_fixed(df: DataFrame, key: str, ts: str, order: str, limit: int) -> DataFrame:
    """L1: admitted iff the request is among the first ``limit`` of its key-second.

    Only the admitted rows need a rank: ``row_number() <= limit`` plans a partial
    ``WindowGroupLimit`` before the shuffle (at most ``limit`` rows per key-second per
    task move), and every row learns its verdict by a join on its id.
    """
    d = df.withColumn("sec", epoch_second(ts))
    w = Window.partitionBy(key, "sec").orderBy(ts, order)
    admitted = (d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
                 .select(order, F.lit(True).alias("allowed")))
    return d.join(admitted, order, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


# --------------------------------------------------------------------- L2 sliding log
PARTS = 8          # buckets per window: more of them tell steady traffic just under the limit from contested


STRETCH = 1024     # buckets of a key that one window partition goes through, 2 * PARTS at least


def contested_buckets(d: DataFrame, key: str, limit: int, window_ms: int) -> DataFrame:
    """(_k, _bk, _seg): the buckets of a ``PARTS``-th of a window whose rows a fold has to see.

    ``d`` has ``_bk``, the bucket of each row.  The log at any row lies in the row's bucket and
    the ``PARTS`` before, so a row can only be refused in a bucket that, with these, holds
    more than ``limit`` rows (hot); such buckets and the ones before them (their log) are contested.
    All of it is windows over the buckets that hold rows, by stretches of buckets: the ones near
    a border go to both sides.  ``_seg`` names runs of contested buckets by their first: a run
    ends where the next hot bucket's log starts after it, so it begins with buckets that refuse
    nothing and need no log."""
    from missive.operators.ordering import binned_running
    n = d.groupBy(F.col(key).alias("_k"), "_bk").agg(F.count(F.lit(1)).alias("n")).where("_bk IS NOT NULL")
    stretch = lambda b: F.floor(b / F.lit(STRETCH)).cast("bigint")
    b = F.col("_bk")
    # a bucket's place in its run needs the run's buckets of PARTS before, and their logs
    n = n.withColumn("_st", F.explode(F.array_distinct(F.array(stretch(b - PARTS), stretch(b), stretch(b + 2 * PARTS)))))
    w = Window.partitionBy("_k", "_st").orderBy("_bk")
    n = n.withColumn("_hot", F.when(F.sum("n").over(w.rangeBetween(-PARTS, 0)) > limit, b))
    n = n.withColumn("_next", F.min("_hot").over(w.rangeBetween(0, PARTS))).where("_next IS NOT NULL")
    last = F.lag("_bk").over(w)
    n = n.withColumn("_first", F.when(last.isNull() | (F.col("_next") - last > PARTS), b)).where(F.col("_st") == stretch(b))
    run = materialize(n.select(F.struct("_k").alias("_kk"), "_bk", "_st", "_first"), "contested_buckets")
    run = binned_running(run, ["_kk"], [b], F.col("_st"), F.col("_first"), "max", "_seg")
    return run.select(F.col("_kk._k").alias("_k"), "_bk", "_seg")


def bucket_of_window(ms, window_ms: int):
    return F.floor(F.col(ms) * PARTS / F.lit(window_ms)).cast("bigint")


def limit_sliding(df: DataFrame, key: str, ts: str, order: str, limit: int,
                  window_ms: int) -> DataFrame:
    """L2: admit iff fewer than ``limit`` *admitted* requests lie in (now - window, now].

    Two tiers.  Rows outside contested buckets are admitted without any sequential step.  The
    others are a fold, as refused requests are not recorded: times are floored to
    milliseconds, and each run of contested buckets is folded on its own, in parallel.  Only a
    key that stays near its limit without a break is sequential.
    """
    from missive.operators.fold import stream_fold

    d = df.withColumn("_ms", F.expr(f"unix_millis(cast({ts} as timestamp))"))
    d = d.withColumn("_bk", bucket_of_window("_ms", window_ms))
    runs = contested_buckets(d, key, limit, window_ms).withColumnRenamed("_bk", "_rb")
    j = d.join(runs, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bk") == F.col("_rb")), "left")
    j = materialize(j.select(*df.columns, "_ms", "_seg"), "sliding_rows")
    free = j.where("_seg IS NULL").select(*df.columns, F.lit(True).alias("allowed"))

    def init():
        return collections.deque()

    def step(log, ms):
        while log and log[0] <= ms - window_ms:
            log.popleft()
        if len(log) < limit:
            log.append(ms)
            return (True,)
        return (False,)

    folded = stream_fold(j.where("_seg IS NOT NULL"), [key, "_seg"], ["_ms", order], ["_ms"], init, step, [("allowed", "boolean")])
    return free.unionByName(folded.select(free.columns))


# -------------------------------------------------------------------- L3 token bucket
def limit_token_bucket(df: DataFrame, key: str, ts: str, order: str, weight: str,
                       capacity: float, rate: float, fail_open: bool | None = None) -> DataFrame:
    """L3 (``operators.token_bucket``): adds ``allowed`` and ``tokens_left``."""
    from missive.operators.token_bucket import limit_token_bucket as bucket
    res = bucket(df, key, ts, order, weight, capacity, rate)
    if fail_open is not None:
        res = res.withColumn("allowed", fail_policy(F.col("allowed"), fail_open))
    return res


def fail_policy(verdict, fail_open: bool):
    """A missing limiter verdict (store unavailable) lets the request through on the
    API (fail open) and counts as refused in the worker (fail closed)."""
    return F.coalesce(verdict, F.lit(fail_open))
