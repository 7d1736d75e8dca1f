"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is run once cold (not reported) and then timed as the median of
``BENCH_RUNS`` warm runs (JVM warm, Spark cache cleared before each run); a
run materialises the full result with a ``noop`` write so nothing is pulled
to the driver.
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenloom.plans.registry import QUERIES  # noqa: E402
from tokenloom.session import get_spark  # noqa: E402

HEADLINE = ["rank_files", "token_budget", "unused_symbols", "find_cycles", "extract_python_facts",
            "extract_ts_facts", "extract_go_facts", "merge_ranges", "session_usage", "hot_files",
            "import_edges", "suggest_rules", "health_score", "diff_context"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in sys.argv[1:]] or [q for q in HEADLINE if q in QUERIES]
    spark = get_spark()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in only:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        samples = []
        for _ in range(runs):
            # no intermediate persisted by an earlier run may be reused
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "median_sec_per_query_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
