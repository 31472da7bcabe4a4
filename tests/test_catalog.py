"""Named queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
# one or two of each family; ``check.py`` runs them all
NAMES = [
    "fuse_scores", "risk_assessment", "live_risk", "call_stage", "quality_gate", "sliced_metrics", "roc_curve_corners", "calibrate_on_dev", "system_benchmark", "split_speaker_disjoint", "balance_classes", "quota_sample",
    "noise_plan", "corpus_breakdown", "sliding_windows", "interval_merge", "running_over_one_hot_call", "bounded_history", "risk_ema", "remote_prob_ema", "call_verdicts", "call_report", "nearest_centroid",
    "ledger_verify", "ledger_verify_against_checkpoints", "snr_tier", "silence_cut", "companding_error", "feature_vectors", "protocol_2019", "corpus_classification", "json_messages", "rolling_window_risk", "call_session_windows",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert compare(duck, entry_module.queries()[name](spark, SF), entry_module.oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "error_rate" in df.columns
