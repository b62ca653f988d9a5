"""Times the headline queries: prints one JSON line.

Each query is planned and run to the end twice (the first run warms the JVM up), with all
columns of the result written to the no-op sink; the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from glyphwarden.plans.registry import QUERIES
from glyphwarden.session import build_session

HEADLINE = [
    "verdict_counts", "scan_plain_doc", "scan_text", "findings_union", "detect_injection", "detect_unicode", "detect_base64",
    "detect_anomaly", "scan_pages_doc", "scan_parts_doc", "scan_cells_doc", "scan_html_doc", "scan_batch",
    "history_page", "user_summary", "trend_gapfill", "category_breakdown", "global_stats", "risk_histogram",
    "user_counters_running", "badge_clean_slate", "badge_award_once", "badges_me", "leaderboard", "identify_scans",
    "clean_accounts", "stream_user_counters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cores}]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cores,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
