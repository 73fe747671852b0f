"""Incremental reads, sources, list queries and row checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hostwarden.functions.text import ilike_pattern
from hostwarden.operators import quality
from hostwarden.plans import intelligence_queries as iq, lists, telemetry_queries as tq
from hostwarden.schemas import ALERTS, DETECTION_FINDINGS
from hostwarden.sources import checkpoints as cp
from hostwarden.sources.registry import DEFAULT_SOURCES, parse_source_names, resolve_sources, source_table


def records(spark, *numbers, channel="C"):
    return spark.createDataFrame(
        [("s", channel, n, i) for i, n in enumerate(numbers)], "source_type string, channel string, record_id bigint, arrival_seq bigint"
    )


def checkpoint(spark, last, channel="C"):
    return spark.createDataFrame([("s", channel, last)], "source_type string, channel string, last_record_id bigint")


def ids(frame):
    return sorted(r.record_id for r in frame.collect())


def test_checkpoint_predicate(spark):
    rows = records(spark, 0, 100, 101, 102)
    assert ids(cp.after_checkpoint(rows, checkpoint(spark, 100))) == [101, 102]
    assert ids(cp.after_checkpoint(rows, checkpoint(spark, 0))) == [0, 100, 101, 102]
    assert ids(cp.after_checkpoint(rows, checkpoint(spark, 100, "D"))) == [0, 100, 101, 102]
    with pytest.raises(Exception, match="negative"):
        cp.after_checkpoint(rows, checkpoint(spark, -1)).collect()


@pytest.mark.parametrize("size", [3, 1500])
def test_next_batch(spark, size):
    rows = records(spark, *range(2000, 0, -1)).unionByName(records(spark, 5, 6, channel="D"))
    batch = cp.next_batch(rows, size)
    assert ids(batch.filter("channel = 'C'")) == list(range(1, size + 1))
    assert ids(batch.filter("channel = 'D'")) == [5, 6]
    with pytest.raises(ValueError):
        cp.next_batch(rows, 0)


def test_checkpoints_never_move_back(spark):
    last = cp.advance_checkpoints(checkpoint(spark, 100), records(spark, 102, 101)).head()
    assert last.last_record_id == 102
    assert cp.advance_checkpoints(checkpoint(spark, 500), records(spark, 102)).head().last_record_id == 500
    assert cp.advance_checkpoints(checkpoint(spark, 5).limit(0), records(spark, 7)).head().last_record_id == 7


def test_load_checkpoints(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"sysmon:Micro/Op a:b": 50, "system:channel": "invalid", "security:channel": -25}')
    rows = cp.read_checkpoint_json(spark, str(tmp_path / "state.json")).collect()
    assert [tuple(r) for r in rows] == [("sysmon", "Micro/Op a:b", 50)]
    (tmp_path / "list.json").write_text("[1, 2]")
    assert cp.read_checkpoint_json(spark, str(tmp_path / "list.json")).count() == 0


def test_sources(spark):
    assert resolve_sources() == DEFAULT_SOURCES and len(DEFAULT_SOURCES) == 8
    assert resolve_sources(("sysmon", "defender")) == ("sysmon", "defender")
    with pytest.raises(ValueError, match="nope"):
        resolve_sources(("nope",))
    assert parse_source_names(" sysmon, ,defender ") == ("sysmon", "defender")
    assert parse_source_names(None) == DEFAULT_SOURCES
    assert source_table(spark).filter("source_type = 'powershell'").count() == 2


@pytest.mark.parametrize(
    ("term", "pattern"),
    [("a", "%a%"), ("c:\\win", "%c:win%"), ("a\\_b", "%a\\_b%"), ("a\\\\b", "%a\\\\b%"), ("a\\", "%a\\%"), ("\\\\\\x", "%\\\\x%")],
)
def test_ilike_pattern(term, pattern):
    assert ilike_pattern(term) == pattern


def test_parameters_are_checked():
    for limit in (0, 501, True, "5"):
        with pytest.raises(ValueError):
            lists.check_limit(limit)
    for score in (-1, 101):
        with pytest.raises(ValueError):
            lists.check_minimum_score(score)
    with pytest.raises(ValueError):
        lists.check_choice("status", "open", ("new",))
    assert lists.check_limit(500) == 500 and lists.check_minimum_score(None) is None


def test_list_filters_and_empty_tables(spark):
    findings = spark.createDataFrame([], DETECTION_FINDINGS)
    assert iq.list_detections(findings, "H", "low", 25).count() == 0
    for bad in ({"severity": "severe"}, {"limit": 0}):
        with pytest.raises(ValueError):
            iq.list_detections(findings, **bad)
    alerts = spark.createDataFrame([], ALERTS)
    with pytest.raises(ValueError):
        iq.list_alerts(alerts, minimum_score=101)
    assert iq.get_alert(alerts, "x").count() == 0
    metrics = spark.createDataFrame([], "host_name string, cpu_percent double, memory_percent double, disk_percent double, boot_time timestamp, collected_at timestamp")
    assert tq.metric_list(metrics, 1).count() == 0


def test_nulls_come_first(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", 2)], "k string, v int")
    assert [r.k for r in lists.newest(rows, "v", ["k"]).collect()] == ["b", "c", "a"]


def test_row_checks(spark):
    rows = spark.createDataFrame([("low", 1), ("bad", 0), (None, 2)], "severity string, rule_version int")
    checks = [quality.severity_domain(), quality.positive_version()]
    assert quality.accepted_rows(rows, checks).count() == 2  # a null value breaks no domain
    assert quality.rejected_rows(rows, checks).head().violations == ["severity_domain", "rule_version_positive"]
    assert quality.rejected_rows(rows, quality.required("severity")).count() == 1
    with pytest.raises(Exception, match="rule_version_positive"):
        quality.accepted_rows(rows, checks, strict=True).collect()
    copies = rows.unionByName(rows)
    assert quality.repeated_ids(copies, "severity").count() == 3
    assert quality.unique_by(copies, "severity", ["rule_version"]).count() == 3


def test_read_contract(spark):
    with pytest.raises(ValueError, match="finding_uuid"):
        quality.read_contract(spark.range(1).withColumn("finding_uuid", F.lit(1)), "detection_findings")


def test_large_batch_limit_is_exact_and_moves_no_event(spark):
    """Against a plain sort: equal and missing ids, several channels, ids at both ends of 64 bits."""
    ends = [-(1 << 63), (1 << 63) - 1]
    numbers = {"C": [*ends, *range(3000), *[700] * 500], "D": [None] * 1300 + [4, 5], "E": [*range(900)], None: [None, *range(1500, 0, -1)]}
    rows = [("s", channel, n, i) for channel, all_ in numbers.items() for i, n in enumerate(all_)]
    frame = spark.createDataFrame(rows, "source_type string, channel string, record_id bigint, arrival_seq bigint")
    for size in (1001, 1203, 1299, 1302):
        batch = cp.next_batch(frame, size)
        plan = batch._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan
        for channel, all_ in numbers.items():
            kept = sorted(all_, key=lambda n: (n is not None, n or 0))
            last = kept[min(size, len(kept)) - 1]
            expected = [n for n in kept if n is None or (last is not None and n <= last)]
            found = [r.record_id for r in batch.filter(batch.channel.eqNullSafe(channel)).collect()]
            assert sorted(found, key=lambda n: (n is not None, n or 0)) == expected, (size, channel)
