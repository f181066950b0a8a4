"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zonetide.plans.catalogue import catalogue  # noqa: E402
from zonetide.session import local_session  # noqa: E402

HEADLINE = """ranked_current_zones zone_hour_rollup zone_hour_mean_bround zone_lags zone_rolling feature_table validate_failed profile_nulls describe_column
hourly_broadcast_join nearest_centroid segments_to_zones neighbor_surplus explanation_tags persistence_counter best_action budget_fold recommendation_cards
action_effectiveness context_ladder resolve_outcomes latest_feedback treatment_gap psi_features score_stats rollback_rule run_kpis zone_performance
bounded_history merged_alerts version_lineage best_f1_threshold threshold_sweep error_by_group stratified_folds nearest_neighbours stream_tumbling""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executors before timing
    queries["zone_lags"].build(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
