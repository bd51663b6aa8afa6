"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: tables (default sf0.1); BENCH_CPUS: local threads (default 8);
BENCH_RUNS: timed runs per query after one warm-up (default 2, median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from proofloom.plans import registry
from proofloom.session import build_session

HEADLINE = [
    "document_chunks",
    "bm25_vocabulary",
    "bm25_search",
    "passages_for_questions",
    "nearest_indicators",
    "chunk_alignment",
    "two_route_alignment",
    "three_route_fusion",
    "html_sections",
    "markdown_sections",
    "short_section_merge",
    "source_contexts",
    "retrieval_diff",
    "run_progress",
    "table_chunks",
    "sorting_plan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    queries, wanted = registry.queries(), sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        def once() -> float:
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        once()
        times[name] = round(statistics.median(once() for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
