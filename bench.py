"""Time headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite import load  # noqa: E402
from suite.session import local_session  # noqa: E402

HEADLINE = ["tier_breaches_latest", "ratio_ldr", "trend_roll_z", "cross_pct_rank", "systemic_stress_index", "asof_backward_quarterly", "combined_fill",
            "rules_findings", "rules_summary", "red_flags_all", "stress_capital", "stress_system_summary", "ews_score", "ews_system_timeline",
            "composite_score", "high_risk_periods", "isolation_forest_scores", "rating_total_grade", "rating_template_result", "text_candidate_limits"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS"))
    queries, _ = load()
    queries["ratio_ldr"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in HEADLINE:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
