"""Times the headline queries on one machine and prints one JSON line.

The statistics of all test tables are collected first, as a query of its own (``collect``); the checks then read them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablegauge.plans import registry  # noqa: E402
from tablegauge.plans.fixture import collected  # noqa: E402
from tablegauge.session import build_session  # noqa: E402

HEADLINE = [
    "stat_density", "stat_histogram_int", "stat_histogram_date", "stat_histogram_decimal", "stat_filtered", "stat_sampled",
    "stat_partition_merge", "usage_rollup", "acc_report", "acc_topn", "acc_top10", "log_rollup", "log_metrics", "log_asof_forward",
    "plan_scalars", "plan_flags", "plan_list", "plan_lookup", "plan_stale_refs", "text_clean", "chk43_keyword_2hop",
    "chk17_name_without_word", "chk04_nearest_event", "chk51_busy_window", "chk01_history", "chk02_cadence", "chk07_threshold",
    "chk15_skew", "chk28_duplicate", "chk30_stale", "chk57_distribution", "chk58_growth", "rep_summary", "stream_mod_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the engine outside the timing
    seconds: dict[str, float] = {}
    todo = {"collect": lambda: collected(spark, sf_dir)["stat"]}
    queries = registry.queries()
    todo.update({name: (lambda name=name: queries[name](spark, sf_dir)) for name in HEADLINE})
    for name, run in todo.items():
        start = time.perf_counter()
        try:
            run().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # a failing query must not hide the others
            print(f"{name} failed: {str(e).splitlines()[0]}", file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
