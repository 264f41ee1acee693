"""Times the order queries; prints one JSON line.

Headline queries run BENCH_RUNS times after a warm-up round and make up ``value``;
the other queries follow, timed once each while BENCH_SECONDS have not passed.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores and
BENCH_RUNS the number of timed runs of a headline query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harborline import session  # noqa: E402
from harborline.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "canonical_lines",
    "fact_orders",
    "order_financials",
    "scenario_orders",
    "summary_by_ship_mode",
    "summary_by_region",
    "summary_by_month",
    "summary_grouping_sets",
    "summary_distinct_orders",
    "dq_row_checks",
    "dq_inconsistent_orders",
    "fact_order_lines_star",
    "region_volume",
    "subcategory_hotspots",
    "state_rates",
    "late_correlations",
    "reconcile_clean",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    until = time.perf_counter() + float(os.environ.get("BENCH_SECONDS", "480"))
    spark = session.build("harborline-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # One round over all queries first, since they share much generated code.
    for name in HEADLINE:
        timed(spark, name, folder)
    seconds = {
        name: round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 3)
        for name in HEADLINE
    }
    total = round(sum(seconds.values()), 3)
    for name in QUERIES:
        if name not in seconds and time.perf_counter() < until:
            seconds[name] = round(timed(spark, name, folder), 3)
    result = {
        "metric": "sum of median headline query times",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
