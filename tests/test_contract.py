"""Registered queries: names, oracles and a sample of strict comparisons."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from traffic import SF

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

# Queries whose result is a trained model, resampled, or describes the run itself.
NO_SQL = {
    "m2_random_forest", "m3_xgboost", "m4_svm", "m5_isolation_forest", "m6_mlp", "m7_grid_search",
    "m9_training_grid", "m10_feature_importances", "m11_ablation", "m11_both_directions", "m12_third_dataset",
    "m13_duplicate_sensitivity", "m15_save_and_load", "c2_model_scoring", "e21_attributions", "e24_run_metadata",
    "e16_bootstrap_interval", "e12_wilcoxon_p_values", "e14_pooled_mcnemar_p_values", "s13_file_hashes",
    "q6_leading_bytes", "z3_live_evaluation", "z8_progress", "r14_summary_document",
}
SAMPLE = [
    "f6_flow_timeout", "g9_features_34", "h10_multi_scale_windows", "l2_heuristic_labels", "a5_alert_records",
    "t12_t14_incidents", "x5_cross_dataset_split", "e4_e5_roc_pr_auc", "b7_drift_score", "b11_pair_correlation",
    "p9_x2_map_unsw", "s2_header_projection",
]


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(SF)


def test_every_other_query_has_an_oracle():
    own = entry.catalog.load()
    assert set(own.QUERIES) - set(own.ORACLES) == NO_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 218 and "label" in df.columns


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("ALL_ORACLES") else SAMPLE)
def test_oracle(spark, oracle, name):
    state, *_ = compare.compare(spark, oracle, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok"
