"""Registered queries against DuckDB on the smallest data. ``LINKGUARD_ALL=1`` runs all of them,
``LINKGUARD_SHARD=2/8`` the second eighth."""

import os

import pytest

import __spark_entry__ as entry
from linkguard.plans.parity import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = """url_normalize url_features uf_fallback rule_high_risk_tld typosquat_matches risk_fuse
risk_explain scan_batch feed_scan_json feed_union_dedup flow_url_extract dns_features whois_features
ip_combined_risk traffic_features eg_resolved alert_throttle alert_apply_status url_upsert ip_upsert
dashboard_summary top_malicious_domains url_search recent_threats ml_roc_points ml_evaluate
ml_explain_local stream_rate_window stream_ip_touch""".split()
SAMPLE += """traffic_by_ip ip_blocklist_scan eg_redirect_chain scan_summary evidence_list append_sinks
export_csv prediction_sink feature_assemble stream_first_seen_domain stream_alert_throttle
stream_ip_profile ml_scale ml_train_logreg ml_explain_model scan_batch_ml""".split()
NAMES = list(entry.queries()) if os.environ.get("LINKGUARD_ALL") else SAMPLE
if os.environ.get("LINKGUARD_SHARD"):
    nth, of = map(int, os.environ["LINKGUARD_SHARD"].split("/"))
    NAMES = list(entry.queries())[nth - 1::of]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, FOLDER, name, entry.queries()[name],
                       entry.oracle_sql().get(name))
    assert ok, note


def test_names():
    assert set(SAMPLE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_feature_table_plan_stays_small(spark):
    plan = entry.queries()["feature_assemble"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 35 and plan.count("FileScan") <= 22
