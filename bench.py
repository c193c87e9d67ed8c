"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (data directory), BENCH_CPUS (local threads),
BENCH_RUNS (warm runs per query, the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crawlframe.operators.lineage import clear  # noqa: E402
from crawlframe.plans import catalog  # noqa: E402
from crawlframe.session import build_session  # noqa: E402
from crawlframe.sources import views  # noqa: E402
from crawlframe.sources.tables import Tables  # noqa: E402

# Stored tables the reports read, in the order they depend on each other.
STAGED = (("page_links", views.page_links), ("visit_results", views.visit_results),
          ("dead_rows", views.dead_rows), ("frontier", views.frontier))
HEADLINE = (
    "extract_emails", "count_keywords", "extract_title", "extract_links", "hunt_mode",
    "domain_stats", "db_stats", "analyze_totals", "email_index", "keyword_index", "deadlink_index",
    "export_emails", "export_keywords", "search_results", "findings", "db_view", "db_view_stats",
    "findings_timeline", "timeline_hourly", "metrics_summary", "status_code_histogram",
    "error_histogram", "top_domains", "new_urls", "classify_links", "robots_allowed", "crawl_depths",
    "upsert_results", "frontier_batch", "frontier_spill", "rate_between_snapshots", "crawl_step",
    "stream_counters", "stream_extract", "stream_new_urls", "stream_dead_links",
)


def run(df) -> None:
    """Execute the whole plan without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("crawlframe-bench", master=f"local[{cpus}]", conf={
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, directory)
    seconds: dict[str, float] = {}
    for name, view in STAGED:
        start = time.perf_counter()
        view(tables)
        seconds[f"stage_{name}"] = time.perf_counter() - start
    only = sys.argv[1:] or HEADLINE
    for name in only:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            run(catalog.QUERIES[name](tables))
            if i:  # the first run warms the JVM
                times.append(time.perf_counter() - start)
        seconds[name] = statistics.median(times)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()},
        "sf": float(directory.rstrip("/").rsplit("sf", 1)[-1]) if "sf" in directory else None,
    }))
    clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
