"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores (default 8).
Every query is planned and run twice into a sink that discards its rows; the second, warm
time counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "line_findings", "rule_join_findings", "all_findings", "file_risk", "project_summary", "file_metrics",
    "context_signals", "shap_features", "finding_summary", "java_diag_findings", "enriched_findings",
    "enriched_risk", "dedup_findings", "line_map", "risk_rollup", "file_report", "finding_navigation",
    "token_counts", "csharp_metrics", "page_links", "broken_links", "rate_limit_violations", "user_sessions",
)


def timed(query, spark, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    from sieveline.plans.registry import QUERIES
    from sieveline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    seconds = {}
    for name in HEADLINE:
        timed(QUERIES[name], spark, sf_dir)
        seconds[name] = round(timed(QUERIES[name], spark, sf_dir), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
