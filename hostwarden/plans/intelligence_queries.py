"""Queries over findings, correlation matches, risk assessments and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostwarden.plans.lists import (
    at_least,
    check_choice,
    check_limit,
    check_minimum_score,
    counts_by,
    equals,
    newest,
    where_all,
)
from hostwarden.schemas import (
    ALERT_STATUSES,
    ALERTS,
    CORRELATION_MATCHES,
    DETECTION_FINDINGS,
    RISK_ASSESSMENTS,
    RISK_LEVELS,
    SEVERITIES,
    columns_of,
)

LIST_LIMIT = 100


def _without(ddl: str, *names: str) -> list[str]:
    return [column for column in columns_of(ddl) if column not in names]


def list_detections(
    findings: DataFrame, source_host: str | None = None, severity: str | None = None, limit: int = LIST_LIMIT
) -> DataFrame:
    check_choice("severity", severity, SEVERITIES)
    chosen = where_all(findings, [equals("source_host", source_host), equals("severity", severity)])
    return newest(chosen, "evaluated_at", ["finding_uuid"], check_limit(limit)).select(
        *_without(DETECTION_FINDINGS, "created_at", "arrival_seq")
    )


def list_correlations(
    matches: DataFrame, source_host: str | None = None, severity: str | None = None, limit: int = LIST_LIMIT
) -> DataFrame:
    check_choice("severity", severity, SEVERITIES)
    chosen = where_all(matches, [equals("source_host", source_host), equals("severity", severity)])
    return newest(chosen, "created_at", ["correlation_uuid"], check_limit(limit)).select(
        *_without(CORRELATION_MATCHES, "correlation_key", "created_at")
    )


def list_risk_assessments(
    assessments: DataFrame,
    source_host: str | None = None,
    level: str | None = None,
    minimum_score: int | None = None,
    limit: int = LIST_LIMIT,
) -> DataFrame:
    check_choice("level", level, RISK_LEVELS)
    conditions = [
        equals("source_host", source_host),
        equals("level", level),
        at_least("score", check_minimum_score(minimum_score)),
    ]
    chosen = where_all(assessments, conditions)
    return newest(chosen, "assessed_at", ["assessment_uuid"], check_limit(limit)).select(
        *_without(RISK_ASSESSMENTS, "created_at")
    )


def list_alerts(
    alerts: DataFrame,
    source_host: str | None = None,
    status: str | None = None,
    risk_level: str | None = None,
    minimum_score: int | None = None,
    limit: int = LIST_LIMIT,
) -> DataFrame:
    check_choice("status", status, ALERT_STATUSES)
    check_choice("risk_level", risk_level, RISK_LEVELS)
    conditions = [
        equals("source_host", source_host),
        equals("status", status),
        equals("risk_level", risk_level),
        at_least("risk_score", check_minimum_score(minimum_score)),
    ]
    chosen = where_all(alerts, conditions)
    return newest(chosen, "created_at", ["alert_uuid"], check_limit(limit)).select(
        *_without(ALERTS, "inserted_at")
    )


def get_alert(alerts: DataFrame, alert_uuid: str) -> DataFrame:
    """The alert with this id, or no row."""
    return alerts.filter(F.col("alert_uuid") == alert_uuid).limit(1).select(*_without(ALERTS, "inserted_at"))


def recent_findings_report(findings: DataFrame, limit: int = 50) -> DataFrame:
    return newest(findings, "created_at", ["finding_uuid"], limit).select(
        "finding_uuid", "rule_id", "rule_version", "title", "severity", "source_host", "source_type",
        "event_id", "event_record_id", "event_time", "evaluated_at", "tags",
    )


def recent_findings_with_evidence(findings: DataFrame, limit: int = 20) -> DataFrame:
    return newest(findings, "created_at", ["finding_uuid"], limit).select(
        "finding_uuid", "rule_id", "rule_version", "title", "severity", "source_host",
        "event_id", "event_record_id", "event_time", "evaluated_at", "evidence", "tags",
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    return counts_by(findings, ["rule_id", "rule_version", "title", "severity"], "finding_count")


def recent_findings_of_rule(
    findings: DataFrame, rule_id: str = "TP-WIN-SYSMON-0002", limit: int = 50
) -> DataFrame:
    chosen = findings.filter(F.col("rule_id") == rule_id)
    return newest(chosen, "event_time", ["finding_uuid"], limit).select(
        "finding_uuid", "source_host", "event_record_id", "event_time", "evidence"
    )


def recent_matches(matches: DataFrame, limit: int = 50) -> DataFrame:
    return newest(matches, "created_at", ["correlation_uuid"], limit).select(
        "correlation_uuid", "correlation_key", "rule_id", "rule_version", "title", "severity",
        "source_host", "first_event_time", "last_event_time", "matched_finding_ids",
        "matched_detection_rule_ids", "tags",
    )


def recent_matches_with_evidence(matches: DataFrame, limit: int = 20) -> DataFrame:
    return newest(matches, "created_at", ["correlation_uuid"], limit).select(
        "correlation_uuid", "rule_id", "rule_version", "title", "severity", "source_host",
        "first_event_time", "last_event_time", "matched_finding_ids", "evidence",
    )


def match_counts(matches: DataFrame) -> DataFrame:
    return counts_by(matches, ["rule_id", "rule_version", "title", "severity"], "match_count")


def recent_assessments(assessments: DataFrame, limit: int = 50) -> DataFrame:
    return newest(assessments, "created_at", ["assessment_uuid"], limit).select(
        "assessment_uuid", "correlation_uuid", "correlation_rule_id", "score", "level",
        "base_score", "source_host", "assessed_at", "explanation",
    )


def recent_assessments_with_evidence(assessments: DataFrame, limit: int = 20) -> DataFrame:
    return newest(assessments, "created_at", ["assessment_uuid"], limit).select(
        "assessment_uuid", "correlation_uuid", "correlation_rule_id", "score", "level",
        "source_host", "assessed_at", "contributions", "evidence",
    )


def highest_risk(assessments: DataFrame, limit: int = 25) -> DataFrame:
    return newest(assessments, "score", ["assessed_at", "assessment_uuid"], limit).select(
        "assessment_uuid", "correlation_uuid", "correlation_rule_id", "score", "level",
        "source_host", "assessed_at", "contributions",
    )


def assessment_counts(assessments: DataFrame) -> DataFrame:
    return counts_by(assessments, ["level"], "assessment_count")


def recent_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    return newest(alerts, "inserted_at", ["alert_uuid"], limit).select(
        "alert_uuid", "assessment_uuid", "correlation_uuid", "correlation_rule_id", "title",
        "risk_score", "risk_level", "status", "source_host", "created_at",
    )


def recent_alerts_short(alerts: DataFrame, limit: int = 20) -> DataFrame:
    return newest(alerts, "inserted_at", ["alert_uuid"], limit).select(
        "alert_uuid", "assessment_uuid", "correlation_uuid", "title", "risk_score", "risk_level",
        "status", "source_host", "created_at",
    )


def open_alerts(alerts: DataFrame) -> DataFrame:
    still_open = alerts.filter(F.col("status").isin("new", "acknowledged"))
    return newest(still_open, "risk_score", ["created_at", "alert_uuid"]).select(
        "alert_uuid", "title", "risk_score", "risk_level", "status", "source_host", "created_at", "summary"
    )


def alert_counts_by_status(alerts: DataFrame) -> DataFrame:
    return counts_by(alerts, ["status"], "alert_count")


def alert_counts_by_level(alerts: DataFrame) -> DataFrame:
    return counts_by(alerts, ["risk_level"], "alert_count")


def investigation_chain(
    alerts: DataFrame, assessments: DataFrame, matches: DataFrame, limit: int = 25
) -> DataFrame:
    """Alerts with their assessment and match, newest first. Which side is small is left to AQE."""
    a = alerts.select(
        "alert_uuid", F.col("title").alias("alert_title"), "status", "risk_score", "risk_level",
        "source_host", F.col("created_at").alias("alert_created_at"), "assessment_uuid", "correlation_uuid",
    )
    r = assessments.select("assessment_uuid", "base_score", "contributions")
    c = matches.select("correlation_uuid", F.col("title").alias("correlation_title"), "matched_finding_ids")
    joined = a.join(r, "assessment_uuid").join(c, "correlation_uuid")
    return newest(joined, "alert_created_at", ["alert_uuid"], limit).select(
        "alert_uuid", "alert_title", "status", "risk_score", "risk_level", "source_host",
        "alert_created_at", "assessment_uuid", "base_score", "contributions", "correlation_uuid",
        "correlation_title", "matched_finding_ids",
    )


def activity_by_host(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("source_host")
        .agg(
            F.count("*").alias("alert_count"),
            F.max("created_at").alias("latest_alert_time"),
            F.max("risk_score").alias("highest_risk_score"),
        )
        .orderBy(F.col("highest_risk_score").desc(), F.col("alert_count").desc(), "source_host")
    )


def existing_tables(
    spark: SparkSession, names: tuple[str, ...] = ("correlation_matches", "risk_assessments", "alerts")
) -> list[Column]:
    """One column per table: its name when the catalog knows it, else null."""
    return [F.lit(name if spark.catalog.tableExists(name) else None).cast("string").alias(name) for name in names]
