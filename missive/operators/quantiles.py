"""Quantiles from mergeable sketches.

A sketch is a table (keys, slot, n): whole numbers counted in slots that are exact up to
``2^(bits+1)`` and beyond that share their leading ``bits + 1`` binary digits, so a slot's middle is
within a factor ``1 / 2^(bits+1)`` of every value in it.  Sketches of windows or tables merge by
adding counts; a key holds at most ``64 * 2^bits`` slots however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 7


def slot_of(value: Column, bits: int = BITS) -> Column:
    """Slot of a whole number; negative numbers count as 0."""
    v = F.greatest(value.cast("bigint"), F.lit(0))
    shift = F.greatest(F.length(F.bin(v)) - (bits + 1), F.lit(0))
    return shift.cast("bigint") * (1 << bits) + F.call_function("shiftright", v, shift)


def slot_middle(slot: Column, bits: int = BITS) -> Column:
    shift = F.greatest(F.floor(slot / F.lit(1 << bits)) - 1, F.lit(0)).cast("int")
    low = F.call_function("shiftleft", slot - shift * (1 << bits), shift)
    return low + F.floor(F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) / 2)


def sketch(df: DataFrame, keys: list[str], value: str, bits: int = BITS) -> DataFrame:
    """(keys, slot, n) of a column's non-null values."""
    x = df.where(F.col(value).isNotNull()).select(*keys, slot_of(F.col(value), bits).alias("slot"))
    return x.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "slot").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], percents: list[int], bits: int = BITS) -> DataFrame:
    """Per key: ``n`` and ``p<percent>``, the middle of the slot that holds the value of nearest
    rank (the smallest with at least that share of the values at or below it)."""
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = sketches.withColumn("_upto", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    reach = lambda p: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col("slot")))
    g = x.groupBy(*keys).agg(F.sum("n").alias("n"), *[reach(p).alias(f"p{p}") for p in percents])
    return g.select(*keys, "n", *[slot_middle(F.col(f"p{p}"), bits).alias(f"p{p}") for p in percents])
