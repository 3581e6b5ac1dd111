"""Token bucket (L3, L4) in two tiers.

A bucket refills ``rate`` tokens a second up to ``capacity``; a request of weight w is
admitted iff the bucket holds w tokens, and a refused one takes none.  If every request were
admitted, the missing tokens after request i would be

    D_i = (A_i - rate t_i) - min over j <= i of (A_{j-1} - rate t_j),   A = running weight,

the running sum reflected at its running minimum.  The bucket never holds less than
``capacity - D_i``, so

* where D never exceeds the capacity since the bucket was last full (the minimum's last
  step), every request is admitted and the tokens left are ``capacity - D_i``: tier one, two
  binned running aggregates and no sequential step;
* only from the first request with D_i > capacity to the end of that busy period is the
  outcome open: tier two folds these rows, starting from the known tokens, and cuts them
  again wherever a pause is long enough to fill the bucket.

Amounts are whole numbers of 1 / (10^6 q) tokens (rate = p / q), so both tiers and any replay
agree to the last unit.  ``sum(weight) * 10^6 * q`` of one key must fit a 64-bit integer;
beyond that the running sum raises an error.  Only a key that asks for more than the rate
over a long time without such a pause is folded sequentially, row by row, as the rule demands.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missive.operators.fold import HOUR_US, stream_fold
from missive.session import materialize


def amounts(capacity: float, rate: float) -> tuple[int, int, int]:
    """(units per token, units per microsecond, capacity in units)."""
    r = Fraction(rate).limit_denominator(1_000_000)
    unit = 1_000_000 * r.denominator
    return unit, r.numerator, int(capacity * unit)


def all_admit_balance(df: DataFrame, key: str, ts: str, order: str, weight: str, capacity: float,
                      rate: float, bin_us: int = HOUR_US) -> DataFrame:
    """Adds ``_us``, ``_w`` (units), ``_short`` (units missing after the row if all were
    admitted), ``_busy`` (equal for the rows since the bucket was last full) and ``_piece``
    (start of the last pause that fills the bucket).

    One window per (key, bin) and one small table of bins: sums, minima and pauses before a
    bin come from the bins before it."""
    unit, p, cap = amounts(capacity, rate)
    w = Window.partitionBy(key, "_bin").orderBy("_us", order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = (df.withColumn("_us", F.expr(f"unix_micros(cast({ts} as timestamp))"))
           .withColumn("_w", F.col(weight).cast("bigint") * unit).withColumn("_bin", F.floor(F.col("_us") / F.lit(bin_us)).cast("bigint")))
    d = d.withColumn("_in", F.sum("_w").over(upto)).withColumn("_lag", F.lag("_us").over(w))
    d = (d.withColumn("_low", F.min(F.col("_in") - F.col("_w") - F.col("_us") * p).over(upto))
          .withColumn("_pause", F.max(F.when((F.col("_us") - F.col("_lag")) * p >= cap, F.col("_us"))).over(upto)).drop("_lag"))
    d = materialize(d, "bucket_bins")
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = d.groupBy(F.col(key).alias("_k"), F.col("_bin").alias("_b")).agg(
        F.sum("_w").alias("_total"), F.min("_low").alias("_lowest"), F.min("_us").alias("_first"), F.max("_us").alias("_last"),
        F.max("_pause").alias("_paused"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).withColumn("_prev", F.max("_last").over(earlier))
    fresh = F.col("_prev").isNull() | ((F.col("_first") - F.col("_prev")) * p >= cap)
    bins = bins.withColumn("_from", F.when(fresh, F.col("_first")))
    bins = (bins.withColumn("_floor", F.min(F.col("_before") + F.col("_lowest")).over(earlier))
                .withColumn("_from", F.coalesce("_from", F.max(F.coalesce("_paused", "_from")).over(earlier)))
                .select("_k", "_b", "_before", "_floor", "_from"))
    j = d.join(bins, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bin") == F.col("_b")))
    busy = F.least(F.col("_floor"), F.col("_before") + F.col("_low"))
    return j.select(*df.columns, "_us", "_w", (F.col("_before") + F.col("_in") - F.col("_us") * p - busy).alias("_short"),
                    busy.alias("_busy"), F.coalesce("_pause", "_from").alias("_piece"))


def split_tiers(d: DataFrame, key: str, order: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """(rows surely admitted, rows whose outcome is open) of ``all_admit_balance``; open rows
    carry ``_tokens``, the tokens before the first open row of their busy period."""
    first = (d.where(F.col("_short") > cap).groupBy(F.col(key).alias("_k"), F.col("_busy").alias("_b"))
              .agg(F.min(F.struct("_us", order)).alias("_first")))
    j = d.join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_busy") == F.col("_b")), "left")
    at = F.struct("_us", order)
    sure = j.where(F.col("_first").isNull() | (at < F.col("_first")))
    open_ = j.where(at >= F.col("_first")).withColumn(
        "_tokens", F.when(at == F.col("_first"), F.lit(cap) - F.col("_short") + F.col("_w")).otherwise(F.lit(cap)))
    return sure, open_


def limit_token_bucket(df: DataFrame, key: str, ts: str, order: str, weight: str,
                       capacity: float, rate: float) -> DataFrame:
    """Adds ``allowed`` and ``tokens_left`` (after the request) to every row; rows of a key
    go by (``ts``, ``order``), which must be unique per key."""
    unit, p, cap = amounts(capacity, rate)
    # both tiers and the search for open periods read the balance: it is written once
    balance = materialize(all_admit_balance(df, key, ts, order, weight, capacity, rate), "bucket_balance")
    sure, open_ = split_tiers(balance, key, order, cap)
    free = sure.select(*df.columns, F.lit(True).alias("allowed"), ((F.lit(cap) - F.col("_short")) / F.lit(float(unit))).alias("tokens_left"))
    group = F.concat_ws("|", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), F.col("_busy").cast("string"), F.col("_piece").cast("string"))
    pieces = open_.select(*df.columns, "_us", "_w", "_tokens", group.alias("_g"))

    def init():
        return [None, 0]                       # tokens (None: first row of a piece), time

    def step(st, us, w, tokens):
        st[0] = tokens if st[0] is None else min(cap, st[0] + (us - st[1]) * p)
        st[1] = us
        ok = st[0] >= w
        if ok:
            st[0] -= w
        return ok, st[0] / unit

    folded = stream_fold(pieces, ["_g"], ["_us", order], ["_us", "_w", "_tokens"], init, step,
                         [("allowed", "boolean"), ("tokens_left", "double")])
    return free.unionByName(folded.select(free.columns))
