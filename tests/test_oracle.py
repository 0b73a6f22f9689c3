"""Registered queries against DuckDB on the driver tables.

By default a few queries of every section run; EMBERFIELD_ORACLE=all runs every
one with an oracle (tests/compare.py does the same with timings).
"""

from __future__ import annotations

import os

import pytest
from compare import SMALL, connect, difference

from emberfield.plans.catalogue import ORACLES, QUERIES

CORE = {
    "persistence_review", "a1_read_detections", "a3_normalise_types", "b1_profile_files", "b4_value_histogram",
    "b6_coverage_matrix", "c4_build_sources", "c7_label_sources", "c9_source_summary", "d3_intensity", "d6_gaps",
    "d8_overpass_timing", "d14_attach_labels", "d16_country_percentile", "e1_monthly_sequence",
    "e4_hard_negative_sample", "e6_robust_scale", "f3_region_summaries", "f9_gradient_texture", "f11_components_8",
    "f14_choose_scene", "g2_stable_panel", "g3_interleave", "g6_attempt_ledger", "g7_stop_point", "h1_sample_weights",
    "h3_grouped_folds", "h7_pu_bags", "h9_document_site_blocks", "i7_normalise_views", "j1_binary_metrics",
    "j2_average_precision", "j4_best_f1_threshold", "j5_macro_f1_threshold", "j6_calibration_table",
    "j12_review_budgets", "j17_block_bootstrap", "k1_late_fusion", "k6_choose_alpha", "k12_acceptance",
    "k15_seed_pipeline_policy", "k19_nested_selection", "l1_table_fingerprint", "l7_panel_complete", "m2_stream_source_months",
    "m3_stream_activity_episodes",
}
NAMES = sorted(ORACLES if os.environ.get("EMBERFIELD_ORACLE") == "all" else CORE)


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    assert difference(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
