"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8); BENCH_QUERIES is a comma
separated list of names, or ``all`` for every registered query.
"""

from __future__ import annotations

import json
import os
import time

from armwatch.checks import QUERIES
from armwatch.session import local_session

HEADLINE = (
    "safety_summary_donation safety_summary_risk safety_summary_events "
    "safety_summary_severity_three_strata safety_calc_ci_both safety_longitudinal_week "
    "safety_general_summary safety_severity_piechart rate_ci_summary rate_diff_ci_summary "
    "enrolment_rate_metrics enrolment_projections enrolment_dense_bar_chart_week "
    "enrolment_model_projections_linear profile_demographics profile_collections "
    "profile_chronology collection_counts_site collection_measures_site collection_summary "
    "collection_distribution volume_collection_summary volume_comparative_gain_gender "
    "volume_longitudinal_week power_posterior dashboard_donations "
    "dashboard_all_demographics dashboard_metrics prepare_safety prepare_plasma prepare_profile"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("armwatch-bench", os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = (list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE)
    queries = {name: QUERIES[name] for name in names}
    QUERIES["safety_summary_risk"](spark, sf_dir).collect()      # start-up is not measured
    times = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
