"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_RUNS how
often each query is timed (the best run counts) after one untimed warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakewright.plans.queries import QUERIES  # noqa: E402
from lakewright.session import build_session  # noqa: E402

HEADLINE = [
    "bucket_histogram",
    "avg_over_threshold",
    "silver_orders",
    "gold_daily_revenue",
    "line_total",
    "append_rows",
    "overwrite_partitions",
    "merge_upsert",
    "merge_partitions",
    "cdc_merge",
    "cdc_collapse",
    "latest_change",
    "incremental_extract",
    "change_summary",
    "recent_snapshots",
    "drop_consecutive_duplicates",
    "page_rows",
    "skew_report",
    "key_skew",
    "timeline_users",
    "parse_driver_log",
    "compact_files",
    "compact_partitions",
    "orphan_rows",
    "duplicate_keys",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory="8g",
        spark_checkpoint_dir=f"file://{tempfile.mkdtemp(prefix='bench-')}",
        spark_cleaner_referenceTracking_cleanCheckpoints="true",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        timed(spark, name, folder)
        timings[name] = round(min(timed(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
