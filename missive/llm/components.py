"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregate (minimum neighbour) and a join back, so a node with any number
of links is combined map-side and split by AQE; no component is gathered anywhere, and
each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import drop_tables, shared_table


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = shared_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
    return (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = shared_table(e.groupBy("u").agg(F.min("v").alias("m")), "cc-low")   # every v is below its u
    down = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return down.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, root): each linked node with the smallest node it can reach.

    Roots themselves are not listed.  Self links, nulls and repeated links are ignored.  The number of
    rounds is logarithmic in practice and not capped: it ends when nothing changes.
    """
    e = (links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = shared_table(e, "cc-links")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        large = shared_table(_large_star(e), "cc-large")
        after = shared_table(_small_star(large), "cc-small")
        drop_tables(e, large)
        e = after
