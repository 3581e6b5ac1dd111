"""Benchmark: run the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all] [--runs N]

Each query is fully executed with the ``noop`` sink (no collect to the driver); the
reported time per query is the best of ``--runs`` runs (default 2, so JIT warm-up of a
query's own code paths is not counted) after one JVM/Python warm-up query; with
``--stat median`` the median is reported instead.  ``value`` is the sum over the queries.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from missive.plans import registry  # noqa: E402
from missive.session import build_session  # noqa: E402

HEADLINE = [
    "disposition", "lifecycle_fold", "validate_first_error", "validate_documents",
    "ingest_strict_json", "ingest_batch_explode", "list_page", "list_envelope", "page_number",
    "relay_batches", "cancel_flag_join", "outcome_apply_join", "dedup_in_batch",
    "limit_sliding", "limit_token_bucket", "breaker_replay", "breaker_asof",
    "commit_watermark", "gauge_over_time", "http_latency_hist", "processed_by_status",
    "batch_status", "audit_legal_moves", "outbox_append",
]


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--all", action="store_true", help="run every registered query")
    ap.add_argument("--runs", type=int, default=2)
    ap.add_argument("--stat", choices=["best", "median"], default="best")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    registry.load_all()
    keys = args.keys or (sorted(registry.QUERIES) if args.all else HEADLINE)
    registry.QUERIES["normalize_request"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for k in keys:
        runs: list[float] = []
        for _ in range(max(1, args.runs)):
            t0 = time.perf_counter()
            try:
                registry.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            except Exception as exc:  # noqa: BLE001
                errors[k] = str(exc).splitlines()[0][:200]
                break
            runs.append(time.perf_counter() - t0)
        if runs:
            runs.sort()
            times[k] = round(runs[0] if args.stat == "best" else runs[len(runs) // 2], 3)
        print(f"{k}: {times.get(k)}", file=sys.stderr)
    spark.stop()
    out = {"metric": "sum_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": cpus, "runs": args.runs, "stat": args.stat}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
