"""Headline queries, timed. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from scoutlake.catalog import load
from scoutlake.session import local_session

HEADLINE = [
    "f2_flow_assembly",
    "f6_flow_timeout",
    "g8_features_20",
    "g9_features_34",
    "h10_multi_scale_windows",
    "l2_heuristic_labels",
    "a5_alert_records",
    "a8_alert_cooldown",
    "t8_t9_threat_score",
    "t12_t14_incidents",
    "b4_running_baseline",
    "b6_snapshots",
    "b7_drift_score",
    "p3_p8_map_cic",
    "q1_q2_audit",
    "x1_stratified_split",
    "x9_duplicate_cap",
    "e4_e5_roc_pr_auc",
    "e13_mcnemar",
    "r4_scanner_summary",
    "z2_stream_flows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = load().QUERIES
    timings = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
