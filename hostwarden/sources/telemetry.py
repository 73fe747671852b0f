"""Telemetry derived from a generic ``events`` table.

``events(event_id, ts, user_id, event_type, value, props)`` carries no Windows
payload. These projections give every row a host, a source, a process and a
command line, so that all operators can run over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostwarden.functions.windows_xml import severity_name

EVENT_NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"

# Fixed values of the mapping.
SOURCE_OF_TYPE = {
    "error": "sysmon",
    "click": "sysmon",
    "view": "windows_system",
    "signup": "windows_security",
    "purchase": "powershell",
}
PROVIDER_OF_SOURCE = {
    "sysmon": "Microsoft-Windows-Sysmon",
    "windows_system": "Service Control Manager",
    "windows_security": "Microsoft-Windows-Security-Auditing",
    "powershell": "Microsoft-Windows-PowerShell",
}
EVENT_ID_OF_SOURCE = {"windows_system": 7036, "windows_security": 4624, "powershell": 4104}
PWSH = r"C:\Program Files\PowerShell\7\pwsh.exe"
POWERSHELL = r"C:\Windows\System32\WindowsPowerShell\v1.0\PowerShell.EXE"
NOTEPAD = r"C:\Windows\System32\notepad.exe"
EXPLORER = r"C:\Windows\explorer.exe"
COMMAND_LINES = (
    "powershell.exe -EncodedCommand SQBFAFgA",
    'powershell.exe "-ENC" SQBF',
    "powershell.exe Get-Process",
    "powershell.exe -encx no",
)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _pick(column: Column, choices: dict) -> Column:
    chosen = F.lit(None)
    for key, value in reversed(choices.items()):
        chosen = F.when(column == key, F.lit(value)).otherwise(chosen)
    return chosen


def telemetry(events: DataFrame) -> DataFrame:
    """Flat telemetry rows; one per event, no shuffle."""
    number, kind = F.col("event_id"), F.col("event_type")
    base = events.select(
        F.concat(F.lit("HOST-"), F.lpad((F.col("user_id") % 5).cast("string"), 2, "0")).alias("source_host"),
        _pick(kind, SOURCE_OF_TYPE).alias("source_type"),
        number.alias("record_id"),
        number.alias("arrival_seq"),
        (number % 7).cast("string").alias("level"),
        F.col("ts").cast("timestamp").alias("time_created"),
        F.when(kind != "error", NOTEPAD).when(number % 3 == 0, PWSH).otherwise(POWERSHELL).alias("image"),
        _pick(number % 4, dict(enumerate(COMMAND_LINES))).alias("command_line"),
        F.concat(F.lit("{"), number.cast("string"), F.lit("}")).alias("process_guid"),
        (1000 + number % 5000).cast("string").alias("process_id"),
        F.concat(F.lit("CORP\\user"), F.col("user_id").cast("string")).alias("user_name"),
        F.concat(
            F.lit("MD5="),
            F.md5("props"),
            F.when(number % 11 == 0, "")
            .when(number % 2 == 0, F.concat(F.lit(",SHA256="), F.sha2(number.cast("string"), 256)))
            .otherwise(F.concat(F.lit(", sha256="), F.sha2(number.cast("string"), 256))),
        ).alias("hashes"),
        F.col("event_type"),
        F.col("props"),
        F.col("value"),
    )
    source, record = F.col("source_type"), F.col("record_id")
    return base.select(
        "*",
        _pick(source, PROVIDER_OF_SOURCE).alias("provider"),
        F.when(source == "sysmon", F.when(record % 7 == 0, 3).otherwise(1))
        .otherwise(_pick(source, EVENT_ID_OF_SOURCE))
        .cast("bigint")
        .alias("event_id"),
        F.when(source == "sysmon", "Microsoft-Windows-Sysmon/Operational")
        .when(source == "windows_system", "System")
        .when(source == "windows_security", "Security")
        .when(record % 2 == 0, "Windows PowerShell")
        .otherwise("Microsoft-Windows-PowerShell/Operational")
        .alias("channel"),
        severity_name(F.col("level")).alias("severity"),
    )


def _payload(rows: DataFrame) -> list[tuple[str, Column]]:
    """EventData of a process event, in document order."""
    return [
        ("ProcessGuid", F.col("process_guid")),
        ("ProcessId", F.col("process_id")),
        ("Image", F.col("image")),
        ("CommandLine", F.col("command_line")),
        ("ParentImage", F.lit(EXPLORER)),
        ("ParentCommandLine", F.lit("explorer.exe")),
        ("User", F.col("user_name")),
        ("Hashes", F.col("hashes")),
    ]


def normalized_events(events: DataFrame) -> DataFrame:
    """The normalized-event layout without the detour over XML text."""
    rows = telemetry(events)
    payload = _payload(rows)
    data = F.create_map(*[part for name, value in payload for part in (F.lit(name), value)])
    message = F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), value) for name, value in payload])
    return rows.select(
        "provider",
        "event_id",
        "record_id",
        "severity",
        "time_created",
        F.col("source_host").alias("computer"),
        "source_type",
        "channel",
        message.alias("message"),
        F.struct(
            "provider",
            "event_id",
            "record_id",
            "level",
            F.col("source_host").alias("computer"),
            data.alias("event_data"),
            F.parse_json(F.lit("{}")).alias("user_data"),
        ).alias("raw"),
        "arrival_seq",
    )


def event_documents(events: DataFrame) -> DataFrame:
    """The same rows rendered as event XML: ``xml``, ``source_type``, ``channel``, ``arrival_seq``.

    Security events carry UserData instead of EventData; their optional elements
    are missing or empty in turn, so the defaults of the parser are used too.
    """
    rows = telemetry(events)

    def element(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    system = F.concat(
        F.lit("<System>"),
        F.concat(F.lit("<Provider Name='"), F.col("provider"), F.lit("'/>")),
        F.concat(F.lit("<EventID Qualifiers='16384'>"), F.col("event_id").cast("string"), F.lit("</EventID>")),
        F.when(F.col("record_id") % 13 == 0, "").otherwise(element("Level", F.col("level"))),
        F.concat(
            F.lit("<TimeCreated SystemTime='"),
            F.date_format("time_created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            F.lit("7Z'/>"),
        ),
        element("EventRecordID", F.col("record_id").cast("string")),
        F.when(F.col("record_id") % 17 == 0, "<Computer></Computer>").otherwise(
            element("Computer", F.col("source_host"))
        ),
        F.lit("</System>"),
    )

    def escaped(value: Column) -> Column:
        return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    event_data = element(
        "EventData",
        F.concat(
            *[
                F.concat(F.lit(f"<Data Name='{name}'>"), escaped(value), F.lit("</Data>"))
                for name, value in _payload(rows)
            ]
        ),
    )
    user_data = element(
        "UserData",
        F.concat(
            F.lit("<LogFileCleared xmlns='urn:log'>"),
            element("SubjectUserName", escaped(F.col("user_name"))),
            element("Code", F.concat(F.lit("00"), F.col("level"))),
            F.lit("</LogFileCleared>"),
        ),
    )
    return rows.select(
        F.concat(
            F.lit(f"<Event xmlns='{EVENT_NAMESPACE}'>"),
            system,
            F.when(F.col("source_type") == "windows_security", user_data).otherwise(event_data),
            F.lit("</Event>"),
        ).alias("xml"),
        "source_type",
        "channel",
        "arrival_seq",
    )


def metric_snapshots(events: DataFrame) -> DataFrame:
    """Host metric snapshots as a collector hands them over, some of them unavailable."""
    value = F.col("value")
    return events.select(
        F.concat(F.lit("HOST-"), F.lpad((F.col("user_id") % 5).cast("string"), 2, "0")).alias("host"),
        (F.col("event_type") != "view").alias("psutil_available"),
        (value % 100).alias("cpu_percent"),
        ((value * 7) % 100).alias("memory_percent"),
        ((value * 13) % 100).alias("disk_percent"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("boot_time"),
        F.col("ts").cast("timestamp").alias("collector_time"),
    )


def host_metrics(events: DataFrame) -> DataFrame:
    """The stored form of every snapshot."""
    return metric_snapshots(events).select(
        F.col("host").alias("host_name"),
        "cpu_percent",
        "memory_percent",
        "disk_percent",
        "boot_time",
        F.col("collector_time").alias("collected_at"),
    )


def commit_time(moment: Column) -> Column:
    """Processing time of a batch that commits on the full hour after ``moment``."""
    return F.date_trunc("hour", moment) + F.expr("INTERVAL 1 HOUR")


def log_events(events: DataFrame) -> DataFrame:
    """The stored form of the log events, with the commit time as ``inserted_at``."""
    from hostwarden.operators.normalize import to_log_events

    return to_log_events(normalized_events(events), default_host="COLLECTOR", stamp=commit_time)


def process_events(events: DataFrame) -> DataFrame:
    from hostwarden.operators.normalize import to_process_events

    return to_process_events(normalized_events(events), stamp=commit_time)


__all__ = [
    "commit_time",
    "event_documents",
    "host_metrics",
    "load_events",
    "log_events",
    "metric_snapshots",
    "normalized_events",
    "process_events",
    "telemetry",
]
