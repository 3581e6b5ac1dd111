"""Delivery metrics (A1-A21) as aggregations over fact tables.

Histograms are cumulative (``le`` inclusive) with ``+Inf``, ``sum`` and ``count``; every
bucket is one ``count_if`` inside a single hash aggregate (partial/final), so there is
no row blow-up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exported metric names (the reference's registry names).
METRIC_HTTP_REQUESTS = "api_http_requests_total"
METRIC_HTTP_DURATION = "api_request_duration_seconds"
METRIC_OUTBOX_DEPTH = "notification_outbox_queue_depth"
METRIC_ZOMBIES = "notification_zombie_recovered_total"

# Bucket bounds of the reference's histograms.
API_LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5]
BATCH_SIZE_BUCKETS = [1, 5, 10, 25, 50, 100, 250, 500, 1000]
PROCESSING_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]
WEBHOOK_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]


def le_label(b: float) -> str:
    """Bucket label as the exposition format prints it (shortest float text)."""
    return format(float(b), "g")


def counter(df: DataFrame, labels: list[str], name: str = "value") -> DataFrame:
    """A counter with labels: ``groupBy(labels).count()`` (partial/final aggregate)."""
    if not labels:
        return df.agg(F.count(F.lit(1)).alias(name))
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias(name))


def histogram(df: DataFrame, labels: list[str], value: str, buckets: list[float],
              digits: int = 6) -> DataFrame:
    """Cumulative histogram: one row per (labels, le) with ``bucket_count``, plus the
    series ``sum`` (rounded to ``digits``) and ``count`` on every row."""
    v = F.col(value)
    aggs = [F.count_if(v <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(buckets)]
    aggs += [F.round(F.sum(v).cast("double"), digits).alias("sum"), F.count(v).alias("count")]
    g = df.groupBy(*labels).agg(*aggs) if labels else df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(le_label(b)).alias("le"), F.col(f"_b{i}").alias("bucket_count"))
                    for i, b in enumerate(buckets)],
                  F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return g.select(*labels, F.explode(arr).alias("_e"), "sum", "count") \
            .select(*labels, "_e.le", "_e.bucket_count", "sum", "count")


def gauge_events(inc: DataFrame, dec: DataFrame, key: str, ts: str) -> DataFrame:
    """W3 input: +1 / -1 events; at equal time the increment sorts first."""
    return (inc.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.lit(1).alias("delta"))
            .unionByName(dec.select(F.col(key).alias("key"), F.col(ts).alias("ts"),
                                    F.lit(-1).alias("delta"))))


def last_value(df: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """A gauge's final value: the value at the greatest order key (``max_by``)."""
    return df.agg(F.max_by(value, F.struct(*order)).alias(name))
