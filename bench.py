"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data folder and BENCH_CPUS (default 8) the local cores.
BENCH_QUERIES may name queries, comma separated, or be ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "f01_publishable_contents", "g01_strategy_performance", "g04_popularity_windows", "g05_daily_consumption",
    "g06_daily_impressions", "g18_user_features", "j05_user_vetoes", "j08_access_level_at_instant", "j10_veto_subtraction",
    "w02_trending_by_section", "w04_section_cap", "w05_session_order", "p4_foreign_keys", "n03_anonymised_users",
    "a01_change_log", "l02_silver_events", "r02_co_viewing", "r04_bridge_contents", "r06_cold_start_contents",
    "r08_item_cooccurrence", "r12_literal_search_bodies", "x03_personal_feed", "x05_near_duplicates",
    "x06_exact_batch_neighbours", "x08_user_profiles", "r10_hybrid_feed", "t04_sessions",
]


def main() -> int:
    from feedlake.plans import registry
    from feedlake.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    jobs = registry.jobs()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(jobs) if chosen == "all" else [q for q in chosen.split(",") if q] or HEADLINE
    spark = build_session("feedlake-bench", f"local[{cpus}]", int(cpus), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    jobs["g01_strategy_performance"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        jobs[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}), flush=True)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
