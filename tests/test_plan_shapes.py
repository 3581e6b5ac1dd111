"""Plan-shape checks over every registered batch query: nothing funnels the data into one
task.  A single-partition exchange may only feed a global aggregate (one row per
partition after the partial step) or the small tables of the ordering helpers: one row per
bin of time, or one per partition (``_pid``, the counts behind global row numbers)."""

import re

from pyspark.sql import functions as F

from tables_dir import SF_SMALL
from missive.plans import registry

ALLOWED_PARENT = re.compile(r"HashAggregate\(keys=\[\]|ObjectHashAggregate\(keys=\[\]|Sort \[_(b(in)?|pid)#")


def test_no_single_partition_funnels(spark):
    registry.load_all()
    bad = []
    for k in sorted(registry.QUERIES):
        if k.startswith("stream_"):
            continue
        plan = registry.QUERIES[k](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                parent = lines[i - 1] if i else ""
                if not ALLOWED_PARENT.search(parent):
                    bad.append((k, parent.strip()[:100]))
    assert not bad, bad


def test_topk_plans(spark):
    registry.load_all()
    page = registry.QUERIES["list_page"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page
    top = registry.QUERIES["top_per_group"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert top.count("WindowGroupLimit") >= 2          # partial (before the shuffle) and final


def test_rows_of_one_row_group_are_dealt_before_costly_work(spark, tmp_path):
    """A table of one row group reaches the work per row in several tasks, whole."""
    from missive.sources.tables import dealt_tables, read_table
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    with dealt_tables("orders"):
        dealt = read_table(spark, str(tmp_path), "orders")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) > 1 and max(sizes) < 500
    assert read_table(spark, str(tmp_path), "orders").rdd.getNumPartitions() == 1
