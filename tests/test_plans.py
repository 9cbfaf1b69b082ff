"""What the plans must not contain at scale."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from tarsift.catalog import QUERIES
from tarsift.operators.content_rules import scan_files

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables here")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    """Every table counts as too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# Broadcast on purpose: the weight table, and the versions that lead a top-k list.
BROADCASTS = {
    "r1_scores": "rule", "g17_c2_samples": "name", "flagship_score_board": "rule",
    "g13_c2_versions": None, "t2_edit_distance_matches": None, "t8_all_pairs": None,
    "t12_name_similarity_report": None, "q5_queue_from_feeds": None, "x1_install_chain_risk": None,
    "s14_finding_documents": None, "u3_replace_findings": None, "g30_latest_runs": None,
}


@pytest.mark.parametrize("name", sorted(BROADCASTS))
def test_joins(spark, no_small_tables, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    keys = set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan))
    assert keys == ({BROADCASTS[name]} if BROADCASTS[name] else set())


def test_the_scan_does_not_shuffle_contents(spark):
    schema = "name string, version string, path string, content binary"
    rows = [("n", "1", f"f{i}.js", b"eval(x)") for i in range(4)]
    plan = plan_of(scan_files(spark.createDataFrame(rows, schema)))
    assert "Exchange" not in plan


def test_stored_reports_read_only_what_they_need(spark, work):
    from tarsift.plans import reports as rp
    from tarsift.plans.store import SCHEMAS

    row = [("n", "1", "c2_webhook", "high", "p", "{}")]
    spark.createDataFrame(row, SCHEMAS["findings"]).write.parquet(work + "/findings")
    findings = spark.read.parquet(work + "/findings")
    plan = plan_of(rp.c2_histogram(rp.Tables(findings, findings, findings, findings)))
    assert "PushedFilters: [IsNotNull(rule), EqualTo(rule,c2_webhook)]" in plan
    assert "ReadSchema: struct<name:string,rule:string>" in plan
