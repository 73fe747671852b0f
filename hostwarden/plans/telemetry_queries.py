"""Queries over log events, process events, host metrics and collector runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.functions.text import ilike, time_text
from hostwarden.plans.lists import counts_by, newest

LIST_LIMIT = 100
LOG_TIES = ["event_record_id", "source_type", "source_host"]
PROCESS_TIES = ["process_guid", "source_host"]
METRIC_TIES = ["host_name"]
RUN_TIES = ["source_host"]


def _log_list(logs: DataFrame, condition: Column | None = None) -> DataFrame:
    chosen = logs if condition is None else logs.filter(condition)
    return newest(chosen, "inserted_at", LOG_TIES, LIST_LIMIT).select(
        "event_record_id",
        F.col("source_host").alias("host"),
        "source_type",
        F.col("provider_name").alias("provider"),
        "event_id",
        "severity",
        time_text(F.col("time_created")).alias("time_created"),
        "message",
    )


def _short_log_list(logs: DataFrame, condition: Column) -> DataFrame:
    return newest(logs.filter(condition), "inserted_at", LOG_TIES, LIST_LIMIT).select(
        F.col("source_host").alias("host"),
        F.col("provider_name").alias("provider"),
        "event_id",
        time_text(F.col("time_created")).alias("time_created"),
        "message",
    )


def latest_logs(logs: DataFrame) -> DataFrame:
    return _log_list(logs)


def logs_of_provider(logs: DataFrame, provider: str) -> DataFrame:
    return _short_log_list(logs, ilike(F.col("provider_name"), provider))


def logs_of_event(logs: DataFrame, event_id: int) -> DataFrame:
    return _short_log_list(logs, F.col("event_id") == event_id)


def search_logs(logs: DataFrame, term: str) -> DataFrame:
    names = ("message", "provider_name", "source_host")
    message, provider, host = (ilike(F.col(name), term) for name in names)
    return _log_list(logs, message | provider | host)


def logs_of_source(logs: DataFrame, source_type: str) -> DataFrame:
    return _log_list(logs, ilike(F.col("source_type"), source_type))


def event_counts(logs: DataFrame) -> DataFrame:
    return counts_by(logs, ["event_id"], "count")


def metric_list(metrics: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest snapshots; ``limit=1`` gives the latest one, or no row."""
    return newest(metrics, "collected_at", METRIC_TIES, limit).select(
        F.col("host_name").alias("host"),
        F.col("cpu_percent").cast("double").alias("cpu_percent"),
        F.col("memory_percent").cast("double").alias("memory_percent"),
        F.col("disk_percent").cast("double").alias("disk_percent"),
        time_text(F.col("boot_time")).alias("boot_time"),
        time_text(F.col("collected_at")).alias("collected_at"),
    )


def recent_logs(logs: DataFrame, limit: int = 50, by: str = "inserted_at") -> DataFrame:
    return newest(logs, by, LOG_TIES, limit)


def logs_by_source(logs: DataFrame) -> DataFrame:
    return counts_by(logs, ["source_type"], "event_count")


def logs_by_provider(logs: DataFrame) -> DataFrame:
    return counts_by(logs, ["provider_name"], "event_count")


def logs_by_event_id(logs: DataFrame) -> DataFrame:
    return counts_by(logs, ["event_id"], "event_count")


def latest_metrics(metrics: DataFrame, limit: int = 20) -> DataFrame:
    return newest(metrics, "collected_at", METRIC_TIES, limit)


def high_usage(metrics: DataFrame, column: str, above: float = 80) -> DataFrame:
    return newest(metrics.filter(F.col(column) > above), "collected_at", METRIC_TIES)


def recent_processes(processes: DataFrame, limit: int = 50) -> DataFrame:
    return newest(processes, "inserted_at", PROCESS_TIES, limit).select(
        "source_host", "image", "command_line", "parent_image", "user_name", "created_at"
    )


def recent_processes_by_creation(processes: DataFrame, limit: int = 50) -> DataFrame:
    return newest(processes, "created_at", PROCESS_TIES, limit).select(
        "source_host", "image", "command_line", "user_name", "created_at"
    )


def powershell_processes(processes: DataFrame) -> DataFrame:
    found = ilike(F.col("image"), "powershell") | ilike(F.col("command_line"), "powershell")
    return newest(processes.filter(found), "created_at", PROCESS_TIES)


def collector_history(runs: DataFrame, limit: int = 50) -> DataFrame:
    return newest(runs, "started_at", RUN_TIES, limit)
