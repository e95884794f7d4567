"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Every query reads its whole tables and writes all its rows to Spark's no-op sink. The site that
the crawl queries read is written before their time starts.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "data_items_fallback", "html_nodes", "extract_links", "detect_selectors", "data_items",
    "crawl_single_page", "crawl_max_pages", "crawl",
    "dedup_urls", "limit_items", "rate_schedule", "resolve_attempts",
    "stats_overview", "list_tasks", "list_sources", "result_preview", "with_source_name",
]


def main():
    from checks import QUERIES
    from checks.tables import Tables
    from harvest.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="bench")
    Tables(spark, folder).site()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
