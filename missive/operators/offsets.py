"""Offset watermark (W2): when does each consumed offset become committed?

Offset o of a partition is committed once every tracked offset <= o is done, so its
commit time is the running ``max`` of completion times along the offsets.  A never
finished offset blocks everything after it: it counts as +infinity, and an infinite
result turns back into null.  Nine partitions would make nine window tasks, so the
running max is binned over offset ranges (``binned_running``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.operators.ordering import binned_running

NEVER = 9223372036854775807          # stands for "not done" inside the running max
OFFSETS_PER_BIN = 4096


def commit_watermark(log: DataFrame, done: str = "done_rank", keys=("topic", "partition"),
                     offset: str = "offset", poison_at: str | None = None) -> DataFrame:
    """Adds ``commit_rank``: completion rank at which the offset is committed (null =
    blocked).  With ``poison_at`` (per row), commits at or after it are void."""
    val = F.coalesce(F.col(done), F.lit(NEVER).cast("bigint"))
    out = binned_running(log, list(keys), [F.col(offset)],
                         F.floor(F.col(offset) / OFFSETS_PER_BIN), val, "max", "_run")
    rank = F.when(F.col("_run") < NEVER, F.col("_run"))
    if poison_at:
        rank = F.when(rank < F.col(poison_at), rank)
    return out.withColumn("commit_rank", rank.cast("bigint")).drop("_run")


def committed_offsets(marked: DataFrame, keys=("topic", "partition"), offset: str = "offset") -> DataFrame:
    """Current watermark per partition: the highest committed offset."""
    return (marked.where(F.col("commit_rank").isNotNull()).groupBy(*keys)
                  .agg(F.max(offset).alias("committed_offset")))
