"""Time the headline queries. Prints one JSON line; BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set it up."""

from __future__ import annotations

import json
import os
import statistics
import time

from fleetlens.catalog import load
from fleetlens.session import local_session

HEADLINE = [
    "flagship", "b1_search_incidents", "c1_recent_incidents", "c3_match_anomalies", "c6_label_next_hour", "d1_remediation_stats",
    "d2_metric_stats", "d11_percentile_all", "d18_evaluate_anomalies_fanout", "e1_rolling", "e10_counter_rate", "e13_action_counts",
    "a1_append_metrics", "a2_export_range", "a8_resolve_incidents", "i10_all_rules", "i1_i4_health_documents", "j2_dedupe",
    "j2_dedupe_stream", "j4_breaker_replay", "k1_extract_features", "k11_fit_forecaster", "k16_failure_features", "l5_fallback_reports", "m3_retain_incidents",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took = {}
    for name in HEADLINE:
        once(name)
        took[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": path.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
