"""Time the headline queries and print one JSON line.

Each query runs to the end with every row computed and none kept.  The sum of
the best of a few runs is the headline figure.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Sweeps and checks with published run times first, then one or two of each kind of operator.
HEADLINE = (
    "x5_sweep_all", "x5_sweep_random", "x4_edge_cases", "v6_compare_formulas", "x6_worked_examples", "i5_derive",
    "sales_report_safe", "j1_inner_equijoin", "j2_ordered_join", "j6_theta_join", "j9_full_outer", "j11_semi_join", "j16_as_of",
    "a1_group_by", "a2_group_collect", "a4_latest", "a5_group_sum", "a9_ordered_fold", "o2_distinct_on",
    "v1_unique", "v2b_removable", "v3_audit_join", "v5_dependency", "e3b_inflation", "e4_chain_loss", "e6_registry_audit",
    "b3_multi_version", "b5b_states_at", "b10_classify", "w4_valid_to", "c5_upsert", "c6_union", "r1_equal", "r8_partition",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))

    from rowgrain.queries import QUERIES
    from rowgrain.session import local_session

    spark = local_session(cpus, "rowgrain-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start-up is not part of any query

    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name:24s} {seconds[name]:8.3f} s  first {runs[0]:.3f} s", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
