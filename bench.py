"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores. Each table there is one file
with one row group, which one task has to read whatever the number of cores; real tables are many files.
So the tables are first written again as ``FILES`` files each, before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postlake.plans.catalog import QUERIES
from postlake.session import local_session, scratch_path, ship_package

FILES = 16
TABLES = ("conversations", "customer", "documents", "events", "labels", "lineitem", "orders", "pages", "part")

HEADLINE = (
    "site_overview",
    "page_signals",
    "listings_from_anchors",
    "absolutize_url",
    "visible_text",
    "html_elements",
    "parse_pages",
    "clean_text",
    "extract_details",
    "tag_terms",
    "text_experience",
    "pack_chunks",
    "chunk_stats",
    "score_responses",
    "detect_dynamic",
    "extract_listing_jobs",
    "classify_sites",
    "dedupe_first",
    "top_n_per",
    "stop_on_no_growth",
    "posting_lifetime",
    "merge_enrichment",
    "upsert_jobs",
    "upsert_sites",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    spread = scratch_path(spark, "bench")
    for table in TABLES:
        spark.read.parquet(f"{folder}/{table}.parquet").repartition(FILES).write.parquet(f"{spread}/{table}.parquet")
    # Start-up, code generation and the Python workers are no part of a query's time.
    for name in ("site_overview", "dedupe_first"):
        QUERIES[name](spark, spread).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, spread).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
