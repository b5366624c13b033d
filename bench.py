"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Each query's
result is fully computed and discarded (``noop`` sink); the reported time includes building its plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "p7_ranked_matches", "j1_candidates", "r35_verdict", "x10_attributes", "m7_records", "c8_prose_documents", "v1_domain_hits", "v3_search",
    "a1_key_figures", "a5_depot_topology", "q3_final_states", "q1_stock_reservations", "e2_chain_verdict", "j7_compatible_surplus",
    "j11_mined_pairs", "u5_duplicate_groups", "h2_review_queue", "st3_current_items",
)


def main() -> None:
    from sparemesh.plans import all_queries
    from sparemesh.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "sparemesh-bench")
    queries = all_queries()
    spark.read.parquet(f"{folder}/part.parquet").count()  # start the executors
    times, total = {}, 0.0
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        total += times[name]
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(total, 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
