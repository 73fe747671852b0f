"""Table layouts and value domains."""

from __future__ import annotations

NORMALIZED_EVENT = """
    provider STRING, event_id BIGINT, record_id BIGINT, severity STRING,
    time_created TIMESTAMP, computer STRING, source_type STRING, channel STRING, message STRING,
    raw STRUCT<provider: STRING, event_id: BIGINT, record_id: BIGINT, level: STRING,
               computer: STRING, event_data: MAP<STRING, STRING>, user_data: VARIANT>,
    arrival_seq BIGINT
"""

LOG_EVENTS = """
    source_host STRING, source_type STRING, provider_name STRING, event_id BIGINT,
    event_record_id BIGINT, severity STRING, time_created TIMESTAMP, message STRING,
    raw_data STRING, inserted_at TIMESTAMP
"""

PROCESS_EVENTS = """
    source_host STRING, process_guid STRING, process_id BIGINT, image STRING,
    command_line STRING, parent_image STRING, parent_command_line STRING, user_name STRING,
    sha256 STRING, created_at TIMESTAMP, inserted_at TIMESTAMP
"""

HOST_METRICS = """
    host_name STRING, cpu_percent DOUBLE, memory_percent DOUBLE, disk_percent DOUBLE,
    boot_time TIMESTAMP, collected_at TIMESTAMP
"""

COLLECTOR_RUNS = """
    source_host STRING, status STRING, events_inserted INT, rejected_count BIGINT,
    started_at TIMESTAMP, finished_at TIMESTAMP, error_message STRING
"""

DETECTION_FINDINGS = """
    finding_uuid STRING, rule_id STRING, rule_version INT, title STRING, severity STRING,
    source_host STRING, source_type STRING, event_id BIGINT, event_record_id BIGINT,
    event_time TIMESTAMP, evaluated_at TIMESTAMP, explanation STRING,
    investigation_steps ARRAY<STRING>, evidence MAP<STRING, STRING>, tags ARRAY<STRING>,
    created_at TIMESTAMP, arrival_seq BIGINT
"""

CORRELATION_MATCHES = """
    correlation_uuid STRING, correlation_key STRING, rule_id STRING, rule_version INT,
    title STRING, severity STRING, source_host STRING, first_event_time TIMESTAMP,
    last_event_time TIMESTAMP, matched_finding_ids ARRAY<STRING>,
    matched_detection_rule_ids ARRAY<STRING>, explanation STRING,
    investigation_steps ARRAY<STRING>, evidence STRING, tags ARRAY<STRING>,
    created_at TIMESTAMP
"""

RISK_ASSESSMENTS = """
    assessment_uuid STRING, correlation_uuid STRING, correlation_rule_id STRING, score INT,
    level STRING, base_score INT,
    contributions ARRAY<STRUCT<provider: STRING, reason: STRING, score_delta: INT, evidence: STRING>>,
    source_host STRING, first_event_time TIMESTAMP, last_event_time TIMESTAMP,
    assessed_at TIMESTAMP, explanation STRING,
    evidence STRUCT<correlation_severity: STRING, correlation_title: STRING,
                    matched_finding_ids: ARRAY<STRING>>,
    created_at TIMESTAMP
"""

ALERTS = """
    alert_uuid STRING, assessment_uuid STRING, correlation_uuid STRING,
    correlation_rule_id STRING, title STRING, risk_score INT, risk_level STRING, status STRING,
    source_host STRING, first_event_time TIMESTAMP, last_event_time TIMESTAMP,
    created_at TIMESTAMP, summary STRING,
    evidence STRUCT<base_score: INT, contribution_count: INT,
                    risk_evidence: STRUCT<correlation_severity: STRING, correlation_title: STRING,
                                          matched_finding_ids: ARRAY<STRING>>>,
    inserted_at TIMESTAMP
"""

CHECKPOINTS = "source_host STRING, source_type STRING, channel STRING, last_record_id BIGINT"

REJECTED_EVENTS = """
    source_type STRING, channel STRING, provider STRING, event_id BIGINT, record_id BIGINT,
    severity STRING, time_created TIMESTAMP, computer STRING, message STRING,
    document STRING, reason STRING, document_hash STRING, arrival_seq BIGINT
"""
COMMITS = "committed_at TIMESTAMP"

# Tables of the store that no list or analyst query names.
STORE_TABLES = {
    "rejected_events": REJECTED_EVENTS,
    "failed_runs": COLLECTOR_RUNS,
    "commits": COMMITS,
    "metric_commits": COMMITS,
}

TABLES = {
    "log_events": LOG_EVENTS,
    "process_events": PROCESS_EVENTS,
    "host_metrics": HOST_METRICS,
    "collector_runs": COLLECTOR_RUNS,
    "detection_findings": DETECTION_FINDINGS,
    "correlation_matches": CORRELATION_MATCHES,
    "risk_assessments": RISK_ASSESSMENTS,
    "alerts": ALERTS,
    "checkpoints": CHECKPOINTS,
}

# Enumerations of the data model.
SEVERITIES = ("informational", "low", "medium", "high", "critical")
RISK_LEVELS = SEVERITIES
ALERT_STATUSES = ("new", "acknowledged", "resolved", "suppressed")
CORRELATION_MODES = ("same_event", "temporal_count")


def columns_of(ddl: str) -> list[str]:
    """Column names of one of the layouts above."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()
