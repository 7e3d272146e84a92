"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` how often each
query runs; the best run counts. Results go to Spark's ``noop`` sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidefeed.session import local_session
from tidefeed.workload.queries import QUERIES

HEADLINE = [
    "q01_feed_desc_first",
    "q02_feed_asc_more",
    "q03_feed_keyrange_desc_first_all_users",
    "q05_feed_retention_range_desc_more_all_users",
    "q06_counted_points_desc_all_users",
    "q07_inclusive_points_desc_all_users",
    "q08_feed_pages_desc",
    "q09_feed_all_users_desc",
    "q11_batch_fetch",
    "q14_monitor_report",
    "w02_append",
    "w03_upsert_by_time",
    "w08_day_chunks",
    "w09_salted_layout",
    "a02_latency_summary",
    "a05_trailing_count_sliced",
    "a06_trailing_count_exact",
    "f05_cells_to_records",
    "f13_assign_ulids",
    "f14_assign_monotonic_ulids",
    "f15_f16_audit_ulids",
    "st01_stream_ingest",
    "st04_stream_trailing_count",
    "st05_stream_feed_top20",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench", shared=tempfile.mkdtemp(prefix="tidefeed-bench-"))
    spark.sparkContext.setLogLevel("OFF")
    timed(spark, "w08_day_chunks", folder)
    seconds = {
        name: round(min(timed(spark, name, folder) for _ in range(runs)), 3) for name in chosen
    }
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder).removeprefix("sf"),
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
