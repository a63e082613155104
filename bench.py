"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and executed twice. ``queries`` holds the second run (warm) and
``cold`` the first, which also writes what later runs reuse. Results go to the no-op sink,
so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from driftlens.session import local_session

HEADLINES = [
    "A1_daily_fact", "A1_daily_fact_bracketed", "A2_executive_kpi", "A3_column_profile", "A4_daily_profile",
    "J1_rate_join", "J7_unmatched_orders", "W2_trailing_median", "W3_lagged_reference",
    "Q_suite_healthy", "Q_suite_incident", "B1_compare_to_baseline", "B6_verify_repair", "B7_bad_repair_report",
    "F1_integer_share", "F3_cohort_share", "F4_counterfactual", "F6_foreign_share", "F10_contract_conformity",
    "L2_upstream", "L4_edge_columns", "L6_blast_radius", "L8_catalog_search", "L9_asset_context", "L11_estate_health",
    "E2_root_cause_gate", "E4_current_hypotheses", "E7_stage_fold", "G1_positive_grade", "A16_outcome_rollup",
    "S1_csv_build", "R1_live_incident_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, name="driftlens-bench")

    from driftlens.suite.catalogue import QUERIES

    timings: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        cold[name], timings[name] = (round(t, 3) for t in runs)
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec",
        "queries": timings, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
