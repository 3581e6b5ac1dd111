"""Invariant audits over a status transition log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SEQ_PER_BIN = 1024


def with_previous(log: DataFrame, key: str = "id", seq: str = "seq", status: str = "status") -> DataFrame:
    """Previous status per id.

    ``lag`` runs inside (id, seq bin) partitions; the first row of a bin takes the last
    status of the nearest earlier bin (``max_by`` per bin, then a running ``last`` over
    the small bin table).  A history that holds a third of all rows still spreads
    over many tasks.
    """
    b = F.floor(F.col(seq) / SEQ_PER_BIN).cast("bigint")
    x = log.withColumn("_b", b)
    bins = x.groupBy(key, "_b").agg(F.max_by(status, seq).alias("_last"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(key, "_b", F.last("_last").over(wb).alias("_before"))
    w = Window.partitionBy(key, "_b").orderBy(seq)
    y = x.withColumn("_lag", F.lag(status).over(w)).join(bins, [key, "_b"], "left")
    first_in_bin = F.row_number().over(w) == 1
    return (y.withColumn("prev_status", F.when(first_in_bin, F.col("_before")).otherwise(F.col("_lag")))
             .drop("_b", "_lag", "_before"))


# Statuses and the legal moves of the lifecycle table.
KNOWN_STATUSES = ("pending", "processing", "delivered", "failed_retrying",
                  "failed_permanently", "canceled")
TERMINAL = ("delivered", "failed_permanently", "canceled")
LEGAL_MOVES = [
    ("pending", "processing"), ("failed_retrying", "processing"),
    ("pending", "canceled"), ("failed_retrying", "canceled"),
    ("processing", "delivered"), ("processing", "failed_retrying"),
    ("processing", "failed_permanently"), ("failed_retrying", "pending"),
    ("processing", "pending"),
]


def audit_types(log: DataFrame, max_retries: int = 3) -> DataFrame:
    """Unknown status or retry_count outside 0..max."""
    bad_status = ~F.col("status").isin(*KNOWN_STATUSES)
    bad_count = (F.col("retry_count") < 0) | (F.col("retry_count") > max_retries)
    return log.where(bad_status | bad_count).select(
        "id", "seq", "status", "retry_count",
        F.when(bad_status, "unknown_status").otherwise("retry_count_out_of_range").alias("reason"))


def audit_terminal_stable(log: DataFrame, terminal: str) -> DataFrame:
    """A row that leaves ``terminal`` (W5 + filter)."""
    p = with_previous(log)
    return p.where((F.col("prev_status") == terminal) & (F.col("status") != terminal)) \
            .select("id", "seq", "prev_status", "status")


def audit_legal_moves(log: DataFrame) -> DataFrame:
    """T4: moves (prev -> status) missing from the legal table; a first row must be
    pending; repeating a status is not a move.  The pair table is fixed (9 rows), so it
    is broadcast."""
    spark = log.sparkSession
    legal = spark.createDataFrame(LEGAL_MOVES, "prev_status string, status string")
    p = with_previous(log)
    moves = p.where(F.col("prev_status").isNull() | (F.col("prev_status") != F.col("status")))
    first_bad = moves.where(F.col("prev_status").isNull() & (F.col("status") != "pending"))
    later = moves.where(F.col("prev_status").isNotNull())
    bad = later.join(F.broadcast(legal), ["prev_status", "status"], "left_anti")
    cols = ["id", "seq", "prev_status", "status"]
    return first_bad.select(*cols).unionByName(bad.select(*cols))


def audit_unresolved(log: DataFrame) -> DataFrame:
    """T5: ids whose last status is not terminal (``max_by`` per id: partial aggregate)."""
    g = log.groupBy("id").agg(F.max_by("status", "seq").alias("last_status"),
                              F.count(F.lit(1)).alias("steps"))
    return g.where(~F.col("last_status").isin(*TERMINAL))


def resolution_sketches(applied: DataFrame) -> DataFrame:
    """T5, time to resolution: sketches (channel, day, slot, n) of the microseconds from creation
    to the move into a terminal status.  ``applied``: rows with ``resolved_at`` (null: not
    resolved); ``day`` is the day of that move."""
    from missive.operators.quantiles import sketch
    took = F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = applied.select("channel", F.to_date("resolved_at").alias("day"), took.alias("took_us"))
    return sketch(rows, ["channel", "day"], "took_us")


def resolution_times(sketches: DataFrame) -> DataFrame:
    """Per channel: resolved rows and the 50th, 95th and 99th percentile (within 1/256) of the
    merged sketches of all days."""
    from missive.operators.quantiles import merge, quantiles
    return quantiles(merge(sketches, ["channel"]), ["channel"], [50, 95, 99])


def audit_dlq_complete(snapshot: DataFrame, dlq_ids: DataFrame) -> DataFrame:
    """failed_permanently rows without a DLQ record (left anti join)."""
    return (snapshot.where(F.col("status") == "failed_permanently").select("id")
                    .join(dlq_ids.select("id"), "id", "left_anti"))


def audit_outbox_complete(snapshot: DataFrame, sendable_outbox: DataFrame) -> DataFrame:
    """Pending rows with no sendable outbox row for them (left anti join)."""
    return (snapshot.where(F.col("status") == "pending").select("id")
                    .join(sendable_outbox.select(F.col("aggregate_id").alias("id")), "id", "left_anti"))
