"""The named telemetry sources and their channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Source name -> (kind, channels).
SOURCES = {
    "windows_system": ("windows_event", ("System",)),
    "windows_application": ("windows_event", ("Application",)),
    "windows_security": ("windows_event", ("Security",)),
    "sysmon": ("windows_event", ("Microsoft-Windows-Sysmon/Operational",)),
    "powershell": (
        "windows_event",
        ("Windows PowerShell", "Microsoft-Windows-PowerShell/Operational"),
    ),
    "defender": ("windows_event", ("Microsoft-Windows-Windows Defender/Operational",)),
    "task_scheduler": ("windows_event", ("Microsoft-Windows-TaskScheduler/Operational",)),
    "health_metrics": ("host_metrics", ()),
}

DEFAULT_SOURCES = tuple(SOURCES)

SOURCES_SCHEMA = "source_type STRING, kind STRING, channel STRING, ordinal INT"


def parse_source_names(text: str | None) -> tuple[str, ...]:
    """Names of a comma-separated setting; empty or missing means all sources."""
    names = tuple(part.strip() for part in (text or "").split(",") if part.strip())
    return names if text else DEFAULT_SOURCES


def resolve_sources(names: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """The requested names in the requested order; an unknown one is an error."""
    requested = DEFAULT_SOURCES if names is None else tuple(names)
    unknown = [name for name in requested if name not in SOURCES]
    if unknown:
        raise ValueError(
            f"unknown telemetry source {unknown[0]!r}; known: {', '.join(sorted(SOURCES))}"
        )
    return requested


def source_table(spark: SparkSession, names: tuple[str, ...] | None = None) -> DataFrame:
    """One row per enabled channel; a source without channels has a null one.

    The row count is fixed by the registry, so broadcasting it is safe at any scale.
    """
    rows = []
    for name in resolve_sources(names):
        kind, channels = SOURCES[name]
        for channel in channels or (None,):
            rows.append((name, kind, channel, len(rows)))
    return spark.createDataFrame(rows, SOURCES_SCHEMA)
