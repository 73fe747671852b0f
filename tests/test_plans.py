"""The physical plans are the intended ones."""

from __future__ import annotations

import dataclasses

import pytest

import __spark_entry__ as entry_points
from hostwarden.operators.detect import detect
from hostwarden.operators.detection_rules import BUILTIN_DETECTION_RULES, ENCODED_POWERSHELL
from hostwarden.plans.registry import normalized_of, table_of
from hostwarden.plans import intelligence_queries as iq

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()


def plan_of(frame) -> str:
    frame.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return frame._jdf.queryExecution().executedPlan().toString()


def test_detection_does_not_shuffle(spark):
    plan = plan_of(detect(normalized_of(spark, FOLDER), BUILTIN_DETECTION_RULES))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_rules_reach_the_scan(spark, tmp_path):
    """Source and event id of the rules are pushed to stored events, also those of many rules."""
    normalized_of(spark, FOLDER).write.parquet(str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    many = [dataclasses.replace(ENCODED_POWERSHELL, rule_id=f"R{i}", event_id=i % 40) for i in range(500)]
    for rules, first in ((BUILTIN_DETECTION_RULES, "EqualTo(event_id,1)"), (many, "In(event_id, [0,1,10")):
        frame = detect(stored, rules)
        plan = plan_of(frame)
        assert "EqualTo(source_type,sysmon)" in plan and first in plan, plan
        assert "Exchange" not in plan and "Python" not in plan
    found = detect(stored, many).groupBy("rule_id").count().collect()
    assert {r["rule_id"] for r in found} <= {f"R{i}" for i in range(500) if i % 40 in (0, 1, 3)} and len(found) >= 13


def test_counts_read_one_column_and_count_before_the_shuffle(spark):
    plan = plan_of(QUERIES["b02_logs_by_source"](spark, FOLDER))
    assert "ReadSchema: struct<event_type:string>" in plan
    assert plan.count("partial_count") == 1


def test_lists_push_filters_and_take_the_top(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    alerts = table_of(spark, FOLDER, "alerts")
    plan = plan_of(iq.list_alerts(alerts, "HOST-01", "new", minimum_score=60))
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(source_host,HOST-01)" in plan and "GreaterThanOrEqual(risk_score,60)" in plan


@pytest.mark.parametrize(
    "name", ["s02_after_checkpoint", "s12_channel_isolation", "d16_insert_if_new", "c02_same_event", "c04_anchored_600",
             "c12_insert_new_matches", "b23_investigation_chain", "v06b_unique_ids"],
)
def test_no_pairwise_join(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_batch_limit_prunes_before_the_shuffle(spark):
    plan = plan_of(QUERIES["s03_next_batch"](spark, FOLDER))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_isolation_parses_documents_once(spark):
    plan = plan_of(QUERIES["s12_channel_isolation"](spark, FOLDER))
    assert "Generate" not in plan and "from_xml" not in plan and plan.count("FileScan") == 4
