"""Every registered query has a plan; a sample of them is compared with its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, difference

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "evlog_task_summary", "evlog_cluster_times", "hp_grid_ht", "experiment_normalized", "best_overall", "box_stats",
    "arff_head_read", "instances_norm2", "tweet_text_features_clean", "replay_chunks", "eval_extended",
    "sgd_prequential_logistic", "ht_split_scores", "outlier_prequential", "tweet_read", "tweet_lexicon_features",
    "tweet_adaptive_bow", "results_read_sgd", "results_read_cluster", "compare_runs_files", "best_report", "hp_decode",
    "kmeans_prequential", "dir_partitions", "tweet_pipeline_sgd", "moa_sampled_metrics", "eval_sampled_window", "stream_outliers",
    "ht_leaf_stats", "ht_one_split", "ht_bayes_prequential", "rf_frozen_prequential", "mc_trees_frozen",
    "feature_ablation_bayes", "evlog_files_cluster_times", "evlog_report", "evlog_latest_of_listing", "pareto_front_3",
    "configs_in_order", "arff_read",
]


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    own = {n for n in queries if not n.startswith("op") and n != "pipeline"}
    assert own - set(sql) <= {
        "evlog_latest_log", "ht_prequential", "ht_grid_prequential", "mc_trees_prequential", "rf_prequential",
        "feature_ablation"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_entry(spark):
    assert entry.entry(spark).count() >= 1
