"""On a stored notifications table the listing filters and the keyset predicate reach
the Parquet scan, and only the listed columns are read."""

import datetime as dt
import uuid

from tables_dir import SF_SMALL
from missive.functions.timefmt import encode_cursor_py
from missive.operators import listing as L
from missive.session import ensure_checkpoint_dir
from missive.sources import derived as D


def test_listing_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")     # untruncated scan details
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/tables/test-notifications-{uuid.uuid4().hex[:8]}"
    D.notifications(spark, SF_SMALL).write.parquet(path)
    table = spark.read.parquet(path)
    cursor = encode_cursor_py(dt.datetime(1998, 1, 1), "00000000-0000-4000-8000-000000003000")
    page = L.list_page(table, status="pending", channel="sms", start="1996-01-01", end="1998-12-31",
                       cursor=cursor, limit=20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    for piece in ("EqualTo(status,pending)", "EqualTo(channel,sms)", "GreaterThanOrEqual(created_at",
                  "LessThan(created_at", "LessThanOrEqual(created_at"):
        assert piece in pushed, (piece, pushed)
    assert "correlation_id" not in plan[plan.index("ReadSchema"):].split("\n")[0]
    rows = page.collect()
    assert len(rows) <= 20 and all(r["status"] == "pending" and r["channel"] == "sms" for r in rows)
    assert all(r["created_at"] <= dt.datetime(1998, 1, 1) for r in rows)
