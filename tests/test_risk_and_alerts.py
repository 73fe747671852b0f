"""Scores, levels, contributions and alerts."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hostwarden.operators.alerts import AlertPolicy, raise_alerts
from hostwarden.operators.risk import BUILTIN_PROVIDERS, RiskPolicy, RiskProvider, assess, contribution


def matches(spark, *rows):
    given = [(f"c{i}", rule, severity, "Title", "HOST-01", ["a", "b"]) for i, (rule, severity) in enumerate(rows)]
    frame = spark.createDataFrame(
        given, "correlation_uuid string, rule_id string, severity string, title string, source_host string, matched_finding_ids array<string>"
    )
    moment = F.lit(datetime(2026, 1, 1))
    return frame.withColumn("first_event_time", moment).withColumn("last_event_time", moment)


def constant(name, delta, carried=None):
    return RiskProvider(name, lambda: F.array(contribution(carried or name, "test", delta)))


def scores(frame, **given):
    rows = assess(frame, stamp=lambda t: t, **given).orderBy("correlation_uuid").collect()
    return [(r.score, r.level, r.base_score, len(r.contributions)) for r in rows]


def test_built_in_scores(spark):
    frame = matches(spark, ("X", "medium"), ("TP-CORR-WIN-0002", "high"), ("X", "low"), ("X", "informational"), ("X", "critical"))
    assert scores(frame) == [
        (40, "medium", 40, 0), (80, "critical", 65, 1), (25, "low", 25, 0), (10, "informational", 10, 0), (85, "critical", 85, 0),
    ]


def test_clamping_and_provider_order(spark):
    frame = matches(spark, ("X", "critical"))
    assert scores(frame, providers=(constant("a", 100),))[0][0] == 100
    assert scores(frame, providers=(constant("a", -300),))[0][0] == 0
    row = assess(frame, providers=(constant("b", 1), constant("a", 2))).head()
    assert [c.provider for c in row.contributions] == ["b", "a"]
    assert row.explanation == "Risk score 88 (critical) derived from base score 85 and 2 contribution(s)."


def test_levels(spark):
    policy = RiskPolicy()
    values = [-5, 0, 19, 20, 39, 40, 59, 60, 79, 80, 150]
    rows = spark.createDataFrame([(v,) for v in values], "v int").select("v", policy.level_of(F.col("v")).alias("l"), policy.clamp(F.col("v")).alias("c"))
    expected = ["informational"] * 3 + ["low"] * 2 + ["medium"] * 2 + ["high"] * 2 + ["critical"] * 2
    got = {r.v: (r.l, r.c) for r in rows.collect()}
    assert [got[v][0] for v in values] == expected
    assert (got[-5][1], got[150][1]) == (0, 100)


def test_foreign_contribution_fails(spark):
    with pytest.raises(Exception, match="other than 'a'"):
        assess(matches(spark, ("X", "low")), providers=(constant("a", 1, "b"),)).collect()


@pytest.mark.parametrize("names", [("a", "a"), (" ",), ("a", " a")])
def test_invalid_provider_names(spark, names):
    with pytest.raises(ValueError):
        assess(matches(spark, ("X", "low")), providers=tuple(constant(n, 1) for n in names))


@pytest.mark.parametrize(
    "change",
    [{"minimum_score": 100}, {"low_max": 10}, {"low_max": 19}, {"high_max": 100}, {"informational_max": -1}],
)
def test_invalid_risk_policies(change):
    with pytest.raises(ValueError):
        RiskPolicy(**change)


def test_alerts(spark):
    frame = assess(matches(spark, ("X", "medium"), ("X", "low"), ("TP-CORR-WIN-0002", "high")), stamp=lambda t: t)
    rows = raise_alerts(frame, stamp=lambda t: t).orderBy("risk_score").collect()
    assert [(r.title, r.risk_score, r.status) for r in rows] == [
        ("Medium Risk Activity on HOST-01", 40, "new"), ("Critical Risk Activity on HOST-01", 80, "new"),
    ]
    assert rows[1].summary == f"Risk assessment {rows[1].assessment_uuid} produced score 80/100 (critical)."
    assert (rows[1].evidence.base_score, rows[1].evidence.contribution_count) == (65, 1)
    assert rows[1].evidence.risk_evidence.matched_finding_ids == ["a", "b"]
    assert raise_alerts(frame, AlertPolicy(81)).count() == 0


def test_invalid_alert_policies():
    for value in (True, "40", 40.0):
        with pytest.raises(TypeError):
            AlertPolicy(value)
    for value in (-1, 101):
        with pytest.raises(ValueError):
            AlertPolicy(value)
    assert len(BUILTIN_PROVIDERS) == 1
