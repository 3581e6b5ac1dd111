"""URL filters: dated list entries become validity intervals, captures are joined as of
their fetch time.

Native.  Entries are first reduced to one state per (key, day), so the intervals of a key
are bounded by the days of the list's history, however many entries or captures the key
has; captures meet them in one equi-join on the key, whose hot keys AQE can split (both
sides of the join are plain exchanges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import let, shared_table

# Host and path of an absolute address (user part and port removed).
HOST_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST_RE, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH_RE, 1)


def keys_of(url: Column) -> Column:
    """Every list key that could match an address: ``host:``, ``domain:`` (each suffix of
    the host at a dot) and ``prefix:`` (the host with each leading part of the path)."""
    def build(host: Column) -> Column:
        labels = F.split(host, r"\.")
        segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
        domains = let(labels, lambda ls: F.transform(F.sequence(F.lit(1), F.size(ls)), lambda i: F.concat(
            F.lit("domain:"), F.array_join(F.slice(ls, i, F.size(ls)), "."))))
        prefixes = let(segments, lambda sg: F.when(F.size(sg) > 0, F.transform(
            F.sequence(F.lit(1), F.size(sg)),
            lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(sg, F.lit(1), i), "/"))))
            .otherwise(F.array().cast("array<string>")))
        return F.when(host == "", F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)))
    return let(F.coalesce(host_of(url), F.lit("")), build)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Entries (key, on_date, listed boolean) to one row per key with ``spans``, its
    intervals [since, until) during which it is listed (``until`` null: still listed).

    Of entries of one key and day a listing wins over a removal.  Rows with a null in any
    of the three columns say nothing and are ignored.
    """
    days = (entries.where("key IS NOT NULL AND on_date IS NOT NULL AND listed IS NOT NULL")
            .groupBy("key", "on_date").agg(F.max("listed").alias("listed")))
    w = Window.partitionBy("key").orderBy("on_date")
    turns = (days.withColumn("before", F.coalesce(F.lag("listed").over(w), F.lit(False)))
             .where("listed <> before")
             .withColumn("until", F.lead("on_date").over(w)).where("listed"))
    return turns.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
        F.col("on_date").alias("since"), "until"))).alias("spans"))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
               time_col: str = "fetched_on") -> DataFrame:
    """Per capture (id, address, fetch date): the entries active at fetch time.

    Returns id, ``fetched_on``, ``host``, ``n_active`` (matching entries active then),
    ``entry`` (the smallest of their keys), ``since`` (its date) and ``kept``.  Repeated
    captures (same id, address and date) give one row; a null or relative address matches
    nothing and is kept; a null date is matched by no interval and kept.
    """
    spans = shared_table(validity_intervals(entries), "url-spans")
    caps = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at")).distinct()
    caps = shared_table(caps, "url-captures")
    probes = caps.select("id", "url", "at", F.explode(keys_of(F.col("url"))).alias("key"))
    hit = (probes.join(spans, "key")
           .withColumn("span", F.get(F.filter("spans", lambda s: (s["since"] <= F.col("at")) & (s["until"].isNull() | (F.col("at") < s["until"]))), F.lit(0)))
           .where("span IS NOT NULL")
           .groupBy("id", "url", "at").agg(F.count("*").alias("n_active"), F.min(F.struct("key", "span.since")).alias("first")))
    out = caps.alias("c").join(hit.alias("h"), F.expr("c.id <=> h.id AND c.url <=> h.url AND c.at <=> h.at"), "left")
    return out.select(F.col("c.id").alias(id_col), F.col("c.at").alias("fetched_on"),
                      F.coalesce(host_of(F.col("c.url")), F.lit("")).alias("host"),
                      F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
                      F.col("first.key").alias("entry"), F.col("first.since").alias("since"),
                      F.col("n_active").isNull().alias("kept"))
