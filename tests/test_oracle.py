"""Registered queries against their SQL twins (the whole list: python tests/oracle.py 0.01)."""

import pytest
from oracle import compare

from cardwatch.catalog import ORACLE, QUERIES

COVERED = """
per_payment features_all features_one traffic_context rank_candidates decide counterfactual combine_model
resolve_attempt resolve_order late_flag join_observations unresolved_checkouts link_incident attempt_rows attempt_filter
device_velocity network_sharing card_reuse_window entity_graph typical_amount tileize merge_tiles sliding_features
change_ewma change_cusum incident_sessions drop_duplicate_views snk_upsert_incidents transition_check shop_spike deescalate
containment_state containment_caps blocked_attempts policy_decide policy_backtest_summary evidence_hash audit_verify lockout
overview_kpis risk_trend burst_shape notify_filter ingestion_metrics latency_percentiles scenario_metrics pool_sweep
canonicalize dedup_deliveries verify_signature pseudonymise ret_purge price_cart pii_scan st_dedup st_tiles st_incidents
ml_features cap_benign_ratio ml_grouped_split ml_threshold ml_operating_point ml_pr_auc ml_reliability
""".split()


@pytest.mark.parametrize("name", COVERED)
def test_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLE[name], sf_dir)
    assert ok, note


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 200
