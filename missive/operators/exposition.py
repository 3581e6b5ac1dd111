"""Metrics as exposition samples (S11): one frame of (metric, labels, value).

Every metric is a frame of facts: its label columns and either a value to add up (counters,
gauges) or an observation (histograms).  All facts go through one aggregate over (metric,
labels): the sum, and for observations one count per bucket bound of the metric, so a hot
label is combined before the shuffle.  A metric with many facts is tallied by its label
columns first (``tallied``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators.metrics import le_label


def label_text(names: list[str]) -> Column:
    """``k="v"`` pairs joined by commas, in the order given."""
    if not names:
        return F.lit("")
    return F.concat_ws(",", *[F.concat(F.lit(f'{n}="'), F.col(n).cast("string"), F.lit('"')) for n in names])


def facts(df: DataFrame, metric: str, labels: list[str], value: str | None = None, bounds: list[float] | None = None,
          ts: str | None = None) -> DataFrame:
    """(metric, labels, value, bounds[, ts]): one fact per row; counters without ``value`` add 1."""
    v = F.lit(1.0) if value is None else F.col(value).cast("double")
    b = F.array(*[F.lit(float(x)) for x in bounds]) if bounds else F.lit(None).cast("array<double>")
    return df.select(F.lit(metric).alias("metric"), label_text(labels).alias("labels"), v.alias("value"), b.alias("bounds"),
                     *([F.col(ts).cast("timestamp").alias("ts")] if ts else []))


def union(all_facts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), all_facts)


def tallies(slots: int) -> list[Column]:
    """The numbers of a (metric, labels) group: total, n and one count per bound."""
    hits = [F.count_if(F.col("value") <= F.get("bounds", F.lit(i))).alias(f"_{i}") for i in range(slots)]
    return [F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), *hits]


def buffers(slots: int) -> list[Column]:
    """The aggregates of a (metric, labels) group: its tallies and bounds."""
    total, n, *hits = tallies(slots)
    return [total, n, F.first("bounds").alias("bounds"), *hits]


def tallied(df: DataFrame, metric: str, labels: list[str], value: str, bounds: list[float], slots: int) -> DataFrame:
    """The tallies of a metric with many facts, taken by its label columns: the text of the
    labels is made once per group, not per fact."""
    v = df.select(*labels, F.col(value).cast("double").alias("value"), F.array(*[F.lit(float(x)) for x in bounds]).alias("bounds"))
    g = v.groupBy(*labels, "bounds").agg(*tallies(slots))
    return g.select(F.lit(metric).alias("metric"), label_text(labels).alias("labels"), "bounds", "total", "n", *[f"_{i}" for i in range(slots)])


def expose(all_facts: list[DataFrame], slots: int, digits: int = 6, more: list[DataFrame] | None = None) -> DataFrame:
    """Samples of all facts; ``slots``: the largest number of bounds of any metric; ``more``:
    frames of ``tallied``.

    A metric has one list of bounds, so it may stand among the keys: with an array among the
    aggregates the facts would be sorted instead of hashed."""
    by = ["metric", "labels", "bounds"]
    g = union(all_facts).groupBy(*by).agg(*tallies(slots))
    if more:
        g = union([g, *more]).groupBy(*by).agg(*[F.sum(c).alias(c) for c in g.columns if c not in by])
    return samples(g, slots, [], digits)


def samples(g: DataFrame, slots: int, keys: list[str], digits: int = 6) -> DataFrame:
    """Groups of ``buffers`` to samples (``keys``, metric, labels, value)."""
    hit = F.array(*[F.col(f"_{i}") for i in range(slots)])

    def with_le(le: Column) -> Column:
        return F.concat(F.col("labels"), F.when(F.col("labels") == "", "").otherwise(","), F.lit('le="'), le, F.lit('"'))

    def sample(suffix: str, labels: Column, value: Column) -> Column:
        return F.struct(F.concat(F.col("metric"), F.lit(suffix)).alias("metric"), labels.alias("labels"), value.cast("double").alias("value"))

    buckets = F.transform(F.sequence(F.lit(0), F.size("bounds") - 1), lambda i: sample(
        "_bucket", with_le(bound_text(F.col("bounds")[i])), hit[i]))
    series = F.array(sample("_bucket", with_le(F.lit("+Inf")), F.col("n")), sample("_sum", F.col("labels"), F.round("total", digits)),
                     sample("_count", F.col("labels"), F.col("n")))
    out = F.when(F.col("bounds").isNull(), F.array(sample("", F.col("labels"), F.round("total", digits)))).otherwise(F.concat(buckets, series))
    return g.select(*keys, F.explode(out).alias("s")).select(*keys, "s.*")


def bound_text(bound: Column) -> Column:
    """A bound as the exposition format prints it: no trailing zeros."""
    return F.call_function("format_number", bound, F.lit("0.######"))


def sample_sql(metric: str, source: str, labels: list[str], value: str | None, bounds: list[float] | None, key: str = "") -> str:
    """The same samples of one metric in SQL (for the oracle); ``key``: a column to group by
    beside the labels and to return."""
    text = " || ',' || ".join(f"'{n}=\"' || {n} || '\"'" for n in labels) or "''"
    keys = [*([key] if key else []), *labels]
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    some = "" if keys else " HAVING count(*) > 0"
    first = f"{key}, " if key else ""
    if not bounds:
        total = f"sum(CAST({value} AS DOUBLE))" if value else "CAST(count(*) AS DOUBLE)"
        return f"SELECT {first}'{metric}' AS metric, {text} AS labels, round({total}, 6) AS value FROM {source}{by}{some}"
    sep = " || ','" if labels else ""
    parts = [f"SELECT {first}'{metric}_bucket' AS metric, {text}{sep} || 'le=\"{le_label(b)}\"' AS labels, CAST(count(*) FILTER (WHERE {value} <= {b}) AS DOUBLE) AS value FROM {source}{by}{some}"
             for b in bounds]
    parts += [f"SELECT {first}'{metric}_bucket', {text}{sep} || 'le=\"+Inf\"', CAST(count(*) AS DOUBLE) FROM {source}{by}{some}",
              f"SELECT {first}'{metric}_sum', {text}, round(CAST(sum({value}) AS DOUBLE), 6) FROM {source}{by}{some}",
              f"SELECT {first}'{metric}_count', {text}, CAST(count(*) AS DOUBLE) FROM {source}{by}{some}"]
    return "\nUNION ALL ".join(parts)
