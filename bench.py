"""

BENCH_SF_DIR  folder of the tables       (default /root/testdata/sf0.1)
BENCH_CPUS    local cores                (default 8)
BENCH_RUNS    timed runs, median taken   (default 1, after one warm-up of the session)
BENCH_ALL     1: every query; default: the headline ones
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from watchfold.plans.catalog import QUERIES  # noqa: E402
from watchfold.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_risky_users", "i3_velocity", "i8_linkage_count", "d5_keyword_scan", "d15_decisions", "f2_threshold_rule",
    "f7_corroborate", "j1_stratified_split", "j6_pr_curve", "j7_average_precision", "j9_cheapest_threshold", "j15_psi",
    "j17_reason_codes", "h5_quantiles", "h6_describe_by", "c1_first_match", "c4_scan_profiles", "d12_worst_frame",
    "e1_fingerprint", "e5_build_chain", "e6_replay_chain", "e8_retention", "a7_append_new", "b3_payload_sha256",
]


def run(spark, folder, name):
    start = time.perf_counter()
    QUERIES[name].plan(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    run(spark, folder, "h4_value_counts")
    times = {n: round(statistics.median(run(spark, folder, n) for _ in range(runs)), 3) for n in names}
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
