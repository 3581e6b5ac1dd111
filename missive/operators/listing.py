"""Listing (P9-P17, O1-O7, S3, S12): filters that reach the Parquet scan, keyset
predicates and top-k plans (``TakeOrderedAndProject`` / ``WindowGroupLimit``)."""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.functions.timefmt import (check_date_range, clamp_limit, date_param,
                                       decode_cursor_py, encode_cursor, parse_date_param,
                                       ntz_lit, rfc3339_nano)

# Column list of a listed row (S3): the table without correlation_id.
LIST_COLUMNS = ["id", "batch_id", "external_id", "idempotency_key", "recipient", "channel",
                "content", "priority", "status", "retry_count", "next_retry_at",
                "created_at", "updated_at"]


def list_order() -> list[Column]:
    """Newest first; PostgreSQL puts nulls first in DESC, so do we."""
    return [F.col("created_at").desc_nulls_first(), F.col("id").desc()]


DEFAULT_LIMIT = 10


def scan_notifications(df: DataFrame) -> DataFrame:
    """S3: the 13-column projection; pruning reaches the scan."""
    return df.select(*LIST_COLUMNS)


def filter_status(status: str | None) -> Column:
    """Optional equality (absent = no restriction)."""
    return F.col("status") == status if status else F.lit(True)


def filter_channel(channel: str | None) -> Column:
    """P10."""
    return F.col("channel") == channel if channel else F.lit(True)


def filter_date_range(start: str | None, end: str | None, col: str = "created_at") -> Column:
    """created_at >= start, <= end; a date-only end covers the whole day.

    Bounds become literals, so the comparison is pushed to the Parquet reader.
    """
    check_date_range(start, end)                          # P16, refuses start > end
    preds = []
    if start:
        s, _ = parse_date_param(start)
        preds.append(F.col(col) >= ntz_lit(s))
    if end:
        e, inclusive = parse_date_param(end, end_of_day=True)
        lit = ntz_lit(e)
        preds.append(F.col(col) <= lit if inclusive else F.col(col) < lit)
    return reduce(and_, preds, F.lit(True))


def filter_compose(status=None, channel=None, start=None, end=None) -> Column:
    """Every optional filter AND-ed; Catalyst folds the ``true`` literals away."""
    return reduce(and_, [filter_status(status), filter_channel(channel),
                         filter_date_range(start, end)])


def keyset_predicate(cursor_time: _dt.datetime, cursor_id: str,
                     tcol: str = "created_at", icol: str = "id") -> Column:
    """(t, id) < (ct, cid), expanded so Parquet gets ``t <= ct`` as a pushed filter."""
    ct = ntz_lit(cursor_time)
    t, i = F.col(tcol), F.col(icol)
    return (t <= ct) & ((t < ct) | ((t == ct) & (i < F.lit(cursor_id))))


def list_page(df: DataFrame, status=None, channel=None, start=None, end=None,
              cursor: str | None = None, limit=DEFAULT_LIMIT) -> DataFrame:
    """O1 (+P12, P13, P17): one page, newest first, ``TakeOrderedAndProject`` plan."""
    n = clamp_limit(limit)
    pred = filter_compose(status, channel, start, end)
    if cursor:
        ct, cid = decode_cursor_py(cursor)
        pred = pred & keyset_predicate(ct, cid)
    return scan_notifications(df.where(pred)).orderBy(*list_order()).limit(n)


def page_meta(page: DataFrame, limit: int) -> DataFrame:
    """O2 + O4: next_cursor (last row of a full page) and has_more, one row."""
    agg = page.agg(F.count(F.lit(1)).alias("n"),
                   F.min_by(F.struct("created_at", "id"),
                            F.struct("created_at", "id")).alias("last"))
    cur = F.when(F.col("n") == limit, encode_cursor(F.col("last.created_at"), F.col("last.id"))) \
           .otherwise(F.lit(""))
    return agg.select(F.lit(limit).alias("limit"), cur.alias("next_cursor"),
                      (cur != "").alias("has_more"))


def list_envelope(page: DataFrame, limit: int) -> DataFrame:
    """``{data:[..], meta:{has_more,limit,next_cursor}}`` as one JSON string.

    Times are RFC3339Nano text and null optional fields are omitted, as in the API.
    The page is at most 100 rows (P17), so collecting it into one array is bounded.
    """
    fields = [rfc3339_nano(c).alias(c) if c in ("next_retry_at", "created_at", "updated_at")
              else F.col(c) for c in LIST_COLUMNS]
    data = page.agg(F.sort_array(F.collect_list(F.struct(
        F.col("created_at").alias("k0"), F.col("id").alias("k1"),
        F.struct(*fields).alias("row"))), asc=False).alias("data"))
    full = F.size("data") == limit                        # one aggregate gives rows and meta
    last = F.try_element_at("data", F.lit(-1))
    cur = F.when(full, encode_cursor(last["k0"], last["k1"])).otherwise(F.lit(""))
    return data.select(F.to_json(F.struct(
        F.transform("data", lambda x: x["row"]).alias("data"),
        F.struct(full.alias("has_more"), F.lit(limit).alias("limit"), cur.alias("next_cursor")).alias("meta"))).alias("envelope"))


def saved_search_check(spark, sf_dir: str) -> DataFrame:
    """P16 as a column predicate over a table of saved date-only searches."""
    from missive.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    x = o.select(k.alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_text"),
                 F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (k % 5 - 2).cast("int")),
                               "yyyy-MM-dd").alias("end_text"))
    start = date_param(F.col("start_text"))
    end_excl = date_param(F.col("end_text"), end_of_day=True)
    return x.select("k", "start_text", "end_text", (start < end_excl).alias("range_ok"))


def batch_listing(df: DataFrame) -> DataFrame:
    """O5 for every batch at once: position of each row in its batch, newest first.

    A batch is at most 1000 rows (admission rule S2), so the window partition is bounded.
    """
    w = Window.partitionBy("batch_id").orderBy(*list_order())
    return df.select("batch_id", "id", "status", "created_at",
                     F.row_number().over(w).cast("bigint").alias("pos"))


def batch_status(df: DataFrame) -> DataFrame:
    """Per batch total and count per status (partial/final hash aggregate)."""
    from missive.sources.derived import STATUSES
    return df.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        *[F.count_if(F.col("status") == st).alias(f"n_{st}") for st in STATUSES])


def retry_due(df: DataFrame, as_of: _dt.datetime) -> Column:
    """P20: failed_retrying and next_retry_at <= now."""
    return (F.col("status") == "failed_retrying") & \
           (F.col("next_retry_at") <= ntz_lit(as_of))


def sweep_limit(df: DataFrame, as_of: _dt.datetime, n: int = 1000) -> DataFrame:
    """Up to ``n`` due retries; the order (next_retry_at, id) is ours."""
    return (df.where(retry_due(df, as_of)).select("id", "next_retry_at", "retry_count")
              .orderBy("next_retry_at", "id").limit(n))


def top_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """First ``n`` rows per group.  ``row_number() <= n`` plans a partial
    ``WindowGroupLimit`` before the shuffle, so only n rows per group per task move."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)
