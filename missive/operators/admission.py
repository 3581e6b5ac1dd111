"""Batch-atomic admission (D2): a batch is admitted iff none of its keys is held by an
earlier *admitted* batch; the keys of a refused batch are not taken.

Decided in rounds, with no pair of batches ever formed:

* per key, the earliest batch that is not refused (``min`` - a partial aggregate);
* a batch whose keys all name it as that earliest batch is admitted (every earlier
  batch sharing a key is refused);
* a batch with a key whose earliest *admitted* batch is earlier is refused.

The rounds see only keys that several batches hold: a batch with none of these is admitted in
the first.  The earliest undecided batch is always decided, so the loop ends; the number of rounds
is the longest chain of conflicts.  Each round's state is checkpointed into the shared
checkpoint folder, so lineage stays short and a lost executor recomputes one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.session import checkpoint_once, ensure_checkpoint_dir, materialize

UNDECIDED, ADMITTED, REFUSED = 0, 1, 2


def batch_atomic_admission(members: DataFrame, batch: str = "batch_no", key: str = "key",
                           order: str = "batch_order", refused_upfront: DataFrame | None = None) -> DataFrame:
    """``members``: one row per (batch, key, order).  Returns (batch, admitted, round).

    Runs until every batch is decided; each round decides at least the earliest."""
    ensure_checkpoint_dir(members.sparkSession)
    m = members.groupBy(F.col(batch).alias("b"), F.col(key).alias("k"), F.col(order).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    m = materialize(m, "admission_members")          # read by each step from here on
    # a key repeated inside one batch refuses it at once
    refused = m.groupBy("b", "k").agg(F.sum("n").alias("n")).where("n > 1").select("b")
    if refused_upfront is not None:
        refused = refused.unionByName(refused_upfront.select(F.col(batch).alias("b")))
    refused = materialize(refused.distinct(), "admission_refused")
    live = m.join(refused, "b", "left_anti").select("b", "k", "o")
    # only a key that several of the others hold can refuse one, so the rounds go over these keys alone
    shared = live.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    held = materialize(live.join(shared, "k", "left_semi"), "admission_held")
    st = (m.groupBy("b").agg(F.min("o").alias("o")).join(refused.withColumn("_no", F.lit(True)), "b", "left")
           .join(held.select("b").distinct().withColumn("_held", F.lit(True)), "b", "left"))
    st = st.select("b", "o", F.when(F.col("_no"), REFUSED).when(F.col("_held"), UNDECIDED).otherwise(ADMITTED).alias("s"),
                   F.when(F.col("_no"), 0).when(F.col("_held").isNull(), 1).alias("r"))
    st = materialize(st, "admission_state")
    settled, st = st.where(F.col("s") != UNDECIDED), checkpoint_once(st.where(F.col("s") == UNDECIDED))
    rnd = 0
    while st.where(F.col("s") == UNDECIDED).limit(1).count() > 0:
        rnd += 1
        ms = held.join(st.select("b", "s"), "b")
        per_key = ms.groupBy("k").agg(
            F.min(F.when(F.col("s") != REFUSED, F.col("o"))).alias("first_live"),
            F.min(F.when(F.col("s") == ADMITTED, F.col("o"))).alias("first_admitted"))
        j = ms.join(per_key, "k")
        verdict = j.groupBy("b").agg(
            F.bool_and(F.col("first_live") == F.col("o")).alias("all_first"),
            F.bool_or(F.coalesce(F.col("first_admitted") < F.col("o"), F.lit(False))).alias("blocked"))
        nxt = st.join(verdict, "b", "left").select(
            "b", "o",
            F.when(F.col("s") != UNDECIDED, F.col("s"))
             .when(F.col("blocked"), F.lit(REFUSED))
             .when(F.col("all_first"), F.lit(ADMITTED))
             .otherwise(F.lit(UNDECIDED)).alias("s"),
            F.when((F.col("s") == UNDECIDED) & (F.col("blocked") | F.col("all_first")), F.lit(rnd))
             .otherwise(F.col("r")).alias("r"))
        st = checkpoint_once(nxt)
    return settled.unionByName(st).select(F.col("b").alias(batch), (F.col("s") == ADMITTED).alias("admitted"),
                     F.col("r").cast("int").alias("round"))
