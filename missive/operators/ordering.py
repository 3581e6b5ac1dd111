"""Running aggregates and row numbers that do not collapse into one task.

``Window.partitionBy(k).orderBy(t)`` puts every row of a key into one task; with few keys
(three topics, nine partitions) or a hot key that is the whole job.  Two shared helpers
replace it with two-pass plans:

* ``binned_running``: per-bin totals, an exclusive prefix over the small bin table, and a
  running aggregate inside each bin (bins are a monotone function of the order).
* ``global_row_number``: range partitioning on (keys, order), per-(partition, key)
  counts, offsets over that small table, and a row number inside each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGS = {"sum": F.sum, "max": F.max, "min": F.min}


def binned_running(df: DataFrame, keys: list[str], order: list[Column], bin_expr: Column,
                   value: Column, how: str = "sum", out: str = "running") -> DataFrame:
    """Running ``how`` of ``value`` per ``keys`` along ``order`` (frame: all rows up to and
    including the current one).  ``bin_expr`` must not decrease along ``order``."""
    agg = _AGGS[how]
    x = df.withColumn("_bin", bin_expr).withColumn("_v", value)
    totals = x.groupBy(*keys, "_bin").agg(agg("_v").alias("_bt"))
    wb = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*keys, "_bin", agg("_bt").over(wb).alias("_before"))
    # the bin before the keys: Spark compares the first column of a sort as a number, and keys may be few texts
    w = Window.partitionBy("_bin", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = x.withColumn("_in", agg("_v").over(w)).join(prefix, [*keys, "_bin"], "left")
    if how == "sum":
        res = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_in")
    elif how == "max":
        res = F.greatest(F.col("_before"), F.col("_in"))
    else:
        res = F.least(F.col("_before"), F.col("_in"))
    return inside.withColumn(out, res).drop("_bin", "_v", "_in", "_before")


def global_row_number(df: DataFrame, order: list[str], keys: list[str] | None = None,
                      out: str = "rn", num_partitions: int | None = None,
                      descending: bool = False) -> DataFrame:
    """Exact ``row_number() OVER (PARTITION BY keys ORDER BY order)`` without a
    single-partition window.

    1. range-partition on (keys, order) and sort inside partitions; tag the partition id
       and cut lineage with a reliable ``checkpoint`` (both passes must see the same rows
       in the same partitions, and a lost executor must not change them);
    2. count rows per (partition id, keys) - a table of about #partitions + #keys rows;
       offsets = exclusive running sum over partition ids per key;
    3. a row number inside each (partition id, keys), plus its offset (null-safe join).

    ``order`` must be a total order (unique), as in every use here.
    """
    from missive.session import checkpoint_once, ensure_checkpoint_dir
    keys = keys or []
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(k) for k in keys] + [F.col(c).desc() if descending else F.col(c) for c in order]
    ranged = (df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
                .withColumn("_pid", F.spark_partition_id()))
    ranged = checkpoint_once(ranged)
    counts = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one plan at every size: null-safe join on (partition id, keys), so null keys are
    # numbered like any other, and a window inside one (partition, key)
    offsets = offsets.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_off")
    cond = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_pid", *keys).orderBy(*sort_cols[len(keys):])
    return (ranged.withColumn("_rn", F.row_number().over(inside)).join(offsets, cond)
            .select(*df.columns, (F.col("_off") + F.col("_rn")).cast("bigint").alias(out)))
