"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "evlog_tasks",
    "evlog_task_summary",
    "evlog_executor_summary",
    "evlog_stage_summary",
    "evlog_cluster_times",
    "metrics_summary",
    "learning_curve",
    "experiment_normalized",
    "experiment_results_table",
    "score_pareto_distance",
    "best_hp_per_conf",
    "box_stats",
    "arff_read",
    "arff_profile_numeric",
    "instances_norm2",
    "tweet_text_features_clean",
    "tweet_lexicon_features",
    "tweet_adaptive_bow",
    "replay_chunks",
    "eval_extended",
    "eval_sampled_window",
    "sgd_prequential_logistic",
    "sgd_grid_prequential",
    "ht_prequential",
    "rf_prequential",
    "ht_grid_prequential",
    "feature_ablation",
    "kmeans_prequential",
    "outlier_prequential",
]


def main() -> None:
    from tunelens.plans import fixtures, registry
    from tunelens.session import local_session, scratch_scope

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    queries = registry.queries()
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    # The log the event-log queries read is laid out once; its cost is a line of its own.
    timed("evlog_store", lambda: fixtures.event_store(spark, sf_dir).limit(1).collect())
    for name in HEADLINE:
        with scratch_scope(spark):
            timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
