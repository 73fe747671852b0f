"""Every operator and query as a function of ``(spark, folder of parquet tables)``.

All inputs derive from the ``events`` table. Arrays, maps and structs are shown as
JSON text and times without zone, so that results can be compared as values.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hostwarden.functions.text import sha256_of, time_text
from hostwarden.operators import normalize as nz, quality, rule_checks
from hostwarden.operators.alerts import AlertPolicy, raise_alerts
from hostwarden.operators.anchored import anchored_groups, candidate_counts
from hostwarden.operators.correlate import (
    REF_FIELDS,
    CorrelationRule,
    correlation_key,
    event_key,
    insert_new_matches,
    match_rows,
    of_rules,
    refs,
    same_event_groups,
    without_copies,
)
from hostwarden.operators.correlation_rules import (
    BUILTIN_CORRELATION_RULES,
    ENCODED_EXECUTION,
    REPEATED_ENCODED,
)
from hostwarden.operators.detect import (
    DetectionRule,
    FieldCondition,
    detect,
    field_text,
    finding_keys,
    is_eligible,
    rule_matches,
)
from hostwarden.operators.detection_rules import (
    BUILTIN_DETECTION_RULES,
    ENCODED_POWERSHELL,
    POWERSHELL_PROCESS,
)
from hostwarden.operators.findings import (
    findings_from_text,
    findings_to_text,
    first_arrivals,
    insert_if_new,
    recent_findings,
)
from hostwarden.operators.risk import (
    BUILTIN_PROVIDERS,
    REPEATED_ACTIVITY,
    RiskPolicy,
    RiskProvider,
    assess,
    contribution,
)
from hostwarden.operators.temporal import full_history_groups
from hostwarden.plans import intelligence_queries as iq, telemetry_queries as tq
from hostwarden.plans.chain import Settings, correlate_history, correlate_new, process
from hostwarden.session import scratch_path
from hostwarden.sources import checkpoints as cp, telemetry as tel
from hostwarden.sources.tables import TableStore
from hostwarden.sources.xml_events import read_event_xml
from hostwarden.streaming.ingest import Ingestion
from hostwarden.streaming.stateful import PROVIDER, correlate_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SETTINGS = Settings(stamp=tel.commit_time)
DEFAULT_HOST = "COLLECTOR"


def shown(rows: DataFrame) -> DataFrame:
    """Nested values as JSON text, times as plain date-times."""

    def form(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.to_json(column).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return column.cast("timestamp_ntz").alias(field.name)
        return column

    return rows.select(*[form(field) for field in rows.schema.fields])


def _text_of(column: str) -> Column:
    """A number that may be missing, as text."""
    return F.col(column).cast("string").alias(column)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register under the function's name; runs in UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return shown(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return function


# ---------------------------------------------------------------- inputs


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel.load_events(spark, sf_dir)


def normalized_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel.normalized_events(events_of(spark, sf_dir))


def in_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as collectors send them. The table may be a single row group, and parsing is costly: all cores share it."""
    return events_of(spark, sf_dir).repartitionByRange(spark.sparkContext.defaultParallelism, "ts", "event_id")


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event XML of every event."""
    return tel.event_documents(in_time_order(spark, sf_dir))


def damaged_documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with every 23rd of the System channel cut off and every 29th without number."""
    record = F.col("arrival_seq")
    cut = F.expr("substring(xml, 1, length(xml) - 8)")
    unnumbered = F.regexp_replace("xml", r"(<EventID[^>]*>)\d+", "$1bad")
    damaged = (
        F.when((F.col("channel") == "System") & (record % 23 == 0), cut)
        .when((F.col("channel") == "System") & (record % 29 == 0), unnumbered)
        .otherwise(F.col("xml"))
    )
    return documents_of(spark, sf_dir).withColumn("xml", damaged)


def parsed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.normalize(documents_of(spark, sf_dir), DEFAULT_HOST)


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(normalized_of(spark, sf_dir), SETTINGS).findings


def repeated_findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings twice, the second time as a replay that arrives after everything else."""
    keys = finding_keys(normalized_of(spark, sf_dir), BUILTIN_DETECTION_RULES, tel.commit_time)
    return keys.unionByName(keys.withColumn("arrival_seq", F.col("arrival_seq") + 1_000_000_000))


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> TableStore:
    """Tables of the whole chain, written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        root = scratch_path(spark, "tables")
        ingestion = Ingestion(spark, root, DEFAULT_HOST, SETTINGS)
        events, attempt = normalized_of(spark, sf_dir), ingestion.store.attempt(0)
        ingestion.store_intelligence(events, attempt)
        ingestion.advance(events, attempt)
        attempt.commit()
        attempt.clear()
        _STORED[key] = root
    return TableStore(spark, _STORED[key])


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return stored(spark, sf_dir).table(name)


# ---------------------------------------------------------------- sources and sinks


@query
def s01_xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    documents_of(spark, sf_dir).select("xml").write.text(path)
    system = F.col("parsed.System")
    return read_event_xml(spark, path).select(
        system["Provider"]["_Name"].alias("provider"),
        system["EventID"].alias("event_id"),
        system["EventRecordID"].cast("bigint").alias("record_id"),
        F.coalesce(F.size("parsed.EventData.Data"), F.lit(0)).alias("data_nodes"),
    )


def _checkpoints(rows: DataFrame) -> DataFrame:
    """Checkpoint per channel: none for System, above everything for Windows PowerShell, else the middle."""
    highest = rows.groupBy("source_type", "channel").agg(F.max("record_id").alias("top"))
    last = (
        F.when(F.col("channel") == "System", 0)
        .when(F.col("channel") == "Windows PowerShell", F.col("top") + 1000)
        .otherwise(F.expr("top div 2"))
    )
    return highest.select("source_type", "channel", last.cast("bigint").alias("last_record_id"))


@query
def s02_after_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir)
    return cp.after_checkpoint(rows, _checkpoints(rows)).select("source_type", "channel", "record_id")


@query
def s03_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.next_batch(normalized_of(spark, sf_dir), 100).select("source_type", "channel", "record_id")


@query
def s04_advance_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir)
    return cp.advance_checkpoints(_checkpoints(rows), rows)


def _host_checkpoints(rows: DataFrame) -> DataFrame:
    """Checkpoint per host and channel: none for the first host, else the middle."""
    highest = rows.groupBy("source_host", "source_type", "channel").agg(F.max("record_id").alias("top"))
    last = F.when(F.col("source_host") == "HOST-00", 0).otherwise(F.expr("top div 2"))
    return highest.select("source_host", "source_type", "channel", last.cast("bigint").alias("last_record_id"))


@query
def s02b_after_host_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir).withColumnRenamed("computer", "source_host")
    return cp.after_checkpoint(rows, _host_checkpoints(rows)).select("source_host", "source_type", "channel", "record_id")


@query
def s02c_limited_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged documents of all hosts, offered three times: a limited batch, the rest, nothing new.

    By batch what was stored and rejected; together they are the documents.
    """
    documents = damaged_documents_of(spark, sf_dir)
    limit = documents.count() // 20
    store = None
    for batch_id, batch_size in enumerate((limit, None, None)):
        root = store.root if store else scratch_path(spark, "limited")
        ingestion = Ingestion(spark, root, DEFAULT_HOST, SETTINGS, skip_processed=True, batch_size=batch_size)
        ingestion.ingest(documents, batch_id)
        store = ingestion.store
    parts = {"stored": store.read("log_events", before=3), "rejected": store.read("rejected_events", before=3)}
    counted = [rows.select("batch_id", *[F.lit(int(name == other)).alias(other) for other in parts]) for name, rows in parts.items()]
    return reduce(DataFrame.unionByName, counted).groupBy("batch_id").agg(*[F.sum(name).alias(name) for name in parts])


@query
def s04b_advance_host_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir).withColumnRenamed("computer", "source_host")
    return cp.advance_checkpoints(_host_checkpoints(rows), rows.filter("record_id % 3 = 0"))


@query
def s05_load_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir)
    per_channel = rows.groupBy("source_type", "channel").agg(F.max("record_id").alias("top"))
    value = (
        F.when(F.col("channel") == "System", "invalid")
        .when(F.col("channel") == "Security", "-25")
        .otherwise(F.col("top").cast("string"))
    )
    return cp.load_checkpoints(
        per_channel.select(F.concat_ws(":", "source_type", "channel").alias("key"), value.alias("value"))
    )


@query
def s06_enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir).drop("source_type")
    found = cp.with_source(rows, ("powershell", "sysmon", "defender"))
    return found.groupBy("source_type", "channel", "ordinal").agg(F.count("*").alias("events"))


@query
def s07_append_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TableStore(spark, scratch_path(spark, "logs"))
    store.write(tel.log_events(events_of(spark, sf_dir)), "log_events", 0)
    return store.read("log_events").drop("batch_id", "event_date")


@query
def s08_append_process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TableStore(spark, scratch_path(spark, "processes"))
    store.write(tel.process_events(events_of(spark, sf_dir)), "process_events", 0)
    return store.read("process_events").drop("batch_id", "event_date")


@query
def s09_append_host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TableStore(spark, scratch_path(spark, "metrics"))
    rows = nz.to_host_metrics(tel.metric_snapshots(events_of(spark, sf_dir)), F.col("collector_time"))
    store.write(rows, "host_metrics", 0)
    return store.read("host_metrics").drop("batch_id")


_INGESTED: dict[tuple[str, str], str] = {}


def ingested(spark: SparkSession, sf_dir: str) -> TableStore:
    """Damaged documents ingested twice: batch 0, then everything again as batch 1, then an
    uncommitted start of batch 2."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INGESTED:
        root = scratch_path(spark, "ingested")
        ingestion = Ingestion(spark, root, DEFAULT_HOST, SETTINGS)
        documents = damaged_documents_of(spark, sf_dir)
        ingestion.ingest(documents, 0)
        ingestion.ingest(documents, 1)
        ingestion.store.write(tel.log_events(in_time_order(spark, sf_dir)), "log_events", 2, by_day=True)
        _INGESTED[key] = root
    return TableStore(spark, _INGESTED[key])


@query
def s10_run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ingested(spark, sf_dir).table("collector_runs")
    return runs.select("source_host", "status", "events_inserted", "rejected_count", "error_message")


@query
def s11_committed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = ingested(spark, sf_dir).table("log_events")
    return logs.groupBy("source_type").agg(F.count("*").alias("events"))


@query
def s11b_repeated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 0 repeated by an attempt that fails, batch 1 by one that commits other rows."""
    store, logs = TableStore(spark, scratch_path(spark, "repeated")), tel.log_events(events_of(spark, sf_dir))
    even = logs.filter("event_record_id % 2 = 0")
    for batch_id, rows, commits in ((0, logs, True), (0, even, False), (1, logs, True), (1, even, True)):
        attempt = store.attempt(batch_id)
        attempt.write(rows, "log_events")
        if commits:
            attempt.commit()
    return store.table("log_events").groupBy("source_type").agg(F.count("*").alias("events"))


@query
def s12_channel_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["source_type", "channel"]
    # Parsing is the cost and four scans follow, so what they count is written once.
    path = scratch_path(spark, "isolation")
    nz.normalize(damaged_documents_of(spark, sf_dir), DEFAULT_HOST).select(*key, "is_bad").write.parquet(path)
    events = spark.read.schema("source_type STRING, channel STRING, is_bad BOOLEAN").parquet(path)
    parts = {"documents": events, "stored": nz.accepted(events), "stored_strict": nz.accepted(events, strict=True)}
    counted = [
        rows.select(*key, *[F.lit(int(name == other)).alias(other) for other in parts])
        for name, rows in parts.items()
    ]
    return reduce(DataFrame.unionByName, counted).groupBy(*key).agg(
        *[F.sum(name).alias(name) for name in parts]
    )


@query
def s13_arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cp.with_source(normalized_of(spark, sf_dir).drop("source_type"))
    return nz.with_arrival(rows.drop("arrival_seq")).select("source_type", "channel", "record_id", "arrival_seq")


@query
def s14_stored_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("detection_findings", "correlation_matches", "risk_assessments", "alerts")
    counts = [
        table_of(spark, sf_dir, name).agg(F.count("*").alias("stored_rows")).withColumn("table_name", F.lit(name))
        for name in names
    ]
    return reduce(DataFrame.unionByName, counts)


# ---------------------------------------------------------------- normalization


@query
def n01_parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_of(spark, sf_dir).select(
        "provider", "event_id", "record_id", "severity", "time_created", "computer", "source_type",
        "channel", "message", "is_bad",
    )


@query
def n02_element_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_of(spark, sf_dir).select("record_id", F.col("raw.level").alias("level"), "computer")


@query
def n03_provider_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    anonymous = F.regexp_replace("xml", "<Provider Name='Service Control Manager'/>", "<Provider/>")
    events = nz.normalize(documents_of(spark, sf_dir).withColumn("xml", anonymous), DEFAULT_HOST)
    return events.groupBy("provider").agg(F.count("*").alias("events"))


@query
def n04_event_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    nameless = F.regexp_replace("xml", "<Data Name='(Image|ParentImage)'>", "<Data>")
    doubled = F.regexp_replace(nameless, "Name='ProcessId'", "Name='User'")
    events = nz.normalize(documents_of(spark, sf_dir).withColumn("xml", doubled), DEFAULT_HOST)
    return events.select("record_id", F.col("raw.event_data").alias("event_data"))


@query
def n05_user_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_of(spark, sf_dir).select("record_id", F.col("raw.user_data").alias("user_data"))


@query
def n06_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_of(spark, sf_dir).select("record_id", "message")


@query
def n07_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_of(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("events"))


@query
def n08_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeless = F.when(F.col("arrival_seq") % 19 == 0, F.regexp_replace("xml", "<TimeCreated[^>]*/>", ""))
    documents = documents_of(spark, sf_dir).withColumn("xml", F.coalesce(timeless, F.col("xml")))
    batch_time = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return nz.normalize(documents, DEFAULT_HOST, batch_time).select("record_id", "time_created")


@query
def n09_strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("arrival_seq") % 5 == 0, F.regexp_replace("xml", r"(<EventRecordID>)\d+", "$1x1"))
    documents = documents_of(spark, sf_dir).withColumn("xml", F.coalesce(bad, F.col("xml")))
    return nz.normalize(documents, DEFAULT_HOST).select("arrival_seq", _text_of("record_id"), "is_bad")


@query
def n10_raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_of(spark, sf_dir).select("record_id", nz.raw_json().alias("raw_data"))


@query
def n11_process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.to_process_events(parsed_of(spark, sf_dir), tel.commit_time)


@query
def n12_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel.telemetry(events_of(spark, sf_dir)).select("record_id", sha256_of(F.col("hashes")).alias("sha256"))


@query
def n13_host_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir)
    nameless = rows.withColumn("computer", F.when(F.col("record_id") % 3 == 0, "").otherwise(F.col("computer")))
    logs = nz.to_log_events(nameless, DEFAULT_HOST, tel.commit_time)
    processes = nz.to_process_events(nameless, tel.commit_time)
    both = logs.select("source_host", F.lit("log").alias("kind")).unionByName(
        processes.select("source_host", F.lit("process").alias("kind"))
    )
    return both.groupBy("kind", "source_host").agg(F.count("*").alias("events"))


@query
def n14_malformed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = nz.normalize(damaged_documents_of(spark, sf_dir), DEFAULT_HOST)
    return nz.rejected(events).select("arrival_seq", "source_type", "channel", _text_of("event_id"), "record_id")


@query
def n15_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = table_of(spark, sf_dir, "alerts")
    return alerts.select("alert_uuid", F.to_json("evidence").alias("evidence"))


# ---------------------------------------------------------------- detection


def _rule(rule_id: str, *conditions: FieldCondition, **given) -> DetectionRule:
    fields = dict(
        rule_id=rule_id, version=1, name=rule_id, description="", severity="low", source_type="sysmon",
        event_id=1, conditions=conditions, explanation="",
    )
    return DetectionRule(**{**fields, **given})


IMAGE, COMMAND = "raw.event_data.Image", "raw.event_data.CommandLine"


def _records(spark: SparkSession, sf_dir: str, *conditions: FieldCondition) -> DataFrame:
    hits = rule_matches(normalized_of(spark, sf_dir), [_rule("T-0001", *conditions)])
    return hits.select("record_id", "evidence")


@query
def d01_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(normalized_of(spark, sf_dir), BUILTIN_DETECTION_RULES, tel.commit_time)


@query
def d02_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    anything = FieldCondition(IMAGE, "contains", ())
    rules = [
        POWERSHELL_PROCESS,
        _rule("T-0003", anything, event_id=3),
        _rule("T-7036", anything, source_type="windows_system", event_id=7036),
        _rule("T-OFF", anything, enabled=False),
        _rule("T-NONE", anything, source_type="SYSMON"),
    ]
    events = normalized_of(spark, sf_dir)
    flags = [F.sum(is_eligible(rule).cast("int")).alias(rule.rule_id.lower().replace("-", "_")) for rule in rules]
    return events.groupBy("source_type").agg(*flags)


@query
def d03_field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parsed_of(spark, sf_dir)
    paths = {
        "image": IMAGE,
        "user": "raw.user_data.LogFileCleared.SubjectUserName",
        "code": "raw.user_data.LogFileCleared.Code",
        "level": "raw.level",
        "record": "raw.record_id",
        "missing_key": "raw.event_data.Nothing",
        "missing_field": "raw.nothing.deeper",
        "beyond_text": "provider.deeper",
    }
    return events.select("record_id", *[field_text(events.schema, p).alias(n) for n, p in paths.items()])


@query
def d04_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, FieldCondition(IMAGE, "equals", (tel.NOTEPAD.upper(), tel.PWSH)))


@query
def d05_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, FieldCondition(COMMAND, "contains", ("PowerShell", "-enc")))


@query
def d06_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, FieldCondition(COMMAND, "contains_any", ("get-", "sqbf")))


@query
def d07_contains_any_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ("-enc", "-encodedcommand", "/enc", "/encodedcommand")
    return _records(spark, sf_dir, FieldCondition(COMMAND, "contains_any_token", values))


@query
def d08_ends_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, FieldCondition(IMAGE, "ends_with", (".exe", "SH.EXE")))


@query
def d09_ends_with_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, FieldCondition(IMAGE, "ends_with_any", ("\\pwsh.exe", "pad.exe")))


@query
def d10_null_case_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {
        "case_kept": FieldCondition(IMAGE, "ends_with", ("PowerShell.EXE",), case_sensitive=True),
        "case_wrong": FieldCondition(IMAGE, "ends_with", ("powershell.exe",), case_sensitive=True),
        "number": FieldCondition("raw.record_id", "ends_with", ("7",)),
        "missing": FieldCondition("raw.event_data.Nothing", "contains", ("",)),
        "no_values_all": FieldCondition(IMAGE, "contains", ()),
        "no_values_any": FieldCondition(IMAGE, "contains_any", ()),
    }
    rules = [_rule(name, condition) for name, condition in conditions.items()]
    hits = finding_keys(normalized_of(spark, sf_dir), rules, tel.commit_time)
    return hits.select("rule_id", "event_record_id")


@query
def d11_conjunction_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(
        spark, sf_dir,
        FieldCondition(IMAGE, "contains", ("POWERSHELL",)),
        FieldCondition(COMMAND, "contains_any", ("get", "ENC")),
        FieldCondition("channel", "equals", ("microsoft-windows-sysmon/operational",)),
    )


@query
def d12_finding_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir)
    odd = rows.withColumn(
        "record_id",
        F.when(F.col("arrival_seq") % 9 == 0, "none").otherwise(F.col("record_id").cast("string")),
    ).withColumn("computer", F.when(F.col("arrival_seq") % 2 == 0, F.col("computer")))
    return detect(odd, BUILTIN_DETECTION_RULES, tel.commit_time).select(
        "finding_uuid", "rule_id", "source_host", _text_of("event_record_id"), "event_time", "evaluated_at", "title",
    )


def _rule_findings(spark: SparkSession, sf_dir: str, rule: DetectionRule) -> DataFrame:
    return detect(normalized_of(spark, sf_dir), [rule], tel.commit_time).select(
        "finding_uuid", "rule_id", "severity", "source_host", "event_record_id", "event_time", "tags"
    )


@query
def d13_faulty_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each event, some of them faulty, with none to two conditions."""
    rules = events_of(spark, sf_dir).select(
        F.col("event_id").alias("rule_no"),
        F.expr("CASE WHEN event_id % 31 = 0 THEN '  ' ELSE concat('R-', event_id div 2) END").alias("rule_id"),
        F.expr("CAST((event_id div 3) % 5 AS INT)").alias("rule_version"),
        F.expr("CASE WHEN event_id % 13 = 0 THEN 'severe' ELSE element_at(array('informational', 'low', 'medium', 'high', 'critical'), CAST(event_id % 5 + 1 AS INT)) END").alias("severity"),
    )
    operators = "array('equals', 'contains', 'contains_any', 'contains_any_token', 'ends_with', 'ends_with_any', 'matches')"
    conditions = rules.filter("rule_no % 3 > 0").select("rule_no", F.expr("explode(sequence(1, rule_no % 3))").alias("place")).select(
        "rule_no", F.expr(f"element_at({operators}, CAST((rule_no + place) % 7 + 1 AS INT))").alias("operator")
    )
    return rule_checks.faulty_detection_rules(rules, conditions)


@query
def d14_powershell_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_findings(spark, sf_dir, POWERSHELL_PROCESS)


@query
def d15_encoded_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_findings(spark, sf_dir, ENCODED_POWERSHELL)


@query
def d16_insert_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalized_of(spark, sf_dir)
    known = finding_keys(events, [POWERSHELL_PROCESS], tel.commit_time)
    fresh = insert_if_new(repeated_findings_of(spark, sf_dir), known)
    return fresh.select("rule_id", "source_host", "event_record_id", "arrival_seq")


@query
def d16b_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed findings; those without record id are kept twice."""
    rows = repeated_findings_of(spark, sf_dir).withColumn(
        "event_record_id", F.when(F.col("event_record_id") % 9 != 0, F.col("event_record_id"))
    )
    return first_arrivals(rows).select("rule_id", "source_host", _text_of("event_record_id"), "arrival_seq")


@query
def d17_recent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = findings_of(spark, sf_dir)
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-05 00:00:00", "2024-01-20 12:00:00"))
    rows = recent_findings(findings, "HOST-02", ["TP-WIN-SYSMON-0002", "TP-OTHER"], start, end)
    return rows.select("finding_uuid", "event_time", "event_record_id")


@query
def d18_typed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = findings_to_text(findings_of(spark, sf_dir))
    holes = text.withColumn("evidence", F.when(F.col("rule_id") == "TP-WIN-SYSMON-0002", F.col("evidence")))
    typed = findings_from_text(holes)
    return typed.select(
        "finding_uuid", F.size("investigation_steps").alias("steps"), "evidence", "tags"
    )


# ---------------------------------------------------------------- correlation

HOURLY = dataclasses.replace(REPEATED_ENCODED, rule_id="T-CORR-3600", window_seconds=3600)
QUARTER = dataclasses.replace(REPEATED_ENCODED, rule_id="T-CORR-900", window_seconds=900)


def _matches(groups: DataFrame, *rules: CorrelationRule) -> DataFrame:
    return match_rows(groups, rules, tel.commit_time).select(
        "correlation_uuid", "rule_id", "source_host", "first_event_time", "last_event_time",
        "matched_finding_ids",
    )


@query
def c01_correlate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = dataclasses.replace(HOURLY, rule_id="T-CORR-OFF", enabled=False)
    found = correlate_history(findings_of(spark, sf_dir), [*BUILTIN_CORRELATION_RULES, HOURLY, off], tel.commit_time)
    return found.groupBy("rule_id", "source_host").agg(
        F.count("*").alias("matches"), F.min("first_event_time").alias("first"), F.max("last_event_time").alias("last")
    )


@query
def c02_same_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(same_event_groups(findings_of(spark, sf_dir), ENCODED_EXECUTION, 0), ENCODED_EXECUTION)


@query
def c03_full_history_600(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(full_history_groups(findings_of(spark, sf_dir), REPEATED_ENCODED, 0), REPEATED_ENCODED)


@query
def c03_full_history_3600(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(full_history_groups(findings_of(spark, sf_dir), HOURLY, 0), HOURLY)


@query
def c04_anchored_600(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(anchored_groups(findings_of(spark, sf_dir), [REPEATED_ENCODED]), REPEATED_ENCODED)


@query
def c04_anchored_3600(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(anchored_groups(findings_of(spark, sf_dir), [HOURLY]), HOURLY)


@query
def c04_anchored_short_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 900 s rule whose look-back is 3600 s because of a disabled longer rule."""
    rules = [QUARTER, dataclasses.replace(HOURLY, enabled=False)]
    return _matches(anchored_groups(findings_of(spark, sf_dir), rules), *rules)


def _shuffled_arrival(findings: DataFrame) -> DataFrame:
    return findings.withColumn("arrival_seq", F.pmod(F.col("arrival_seq") * 7919, F.lit(1_000_003)))


@query
def c04_anchored_late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _shuffled_arrival(findings_of(spark, sf_dir))
    return _matches(anchored_groups(findings, [HOURLY]), HOURLY)


@query
def c05_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings_of(spark, sf_dir).withColumn(
        "event_record_id", F.when(F.col("event_record_id") % 9 != 0, F.col("event_record_id"))
    )
    keys = ["source_host", "event_record_id"]
    grouped = of_rules(refs(rows), [r.rule_id for r in BUILTIN_DETECTION_RULES], keys).groupBy(*keys)
    return grouped.agg(F.count("*").alias("findings"))


@query
def c06_without_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = refs(repeated_findings_of(spark, sf_dir))
    return without_copies(rows).select("finding_uuid", "rule_id", "source_host", "event_record_id", "arrival_seq")


@query
def c07_first_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First finding of each required rule per host, in the order of the rule's list."""
    rule = dataclasses.replace(
        ENCODED_EXECUTION, group_by=("source_host",), window_seconds=10_000_000,
        required_detection_rule_ids=("TP-WIN-SYSMON-0002", "TP-WIN-SYSMON-0001"),
    )
    groups = same_event_groups(findings_of(spark, sf_dir), rule, 0)
    return groups.select(
        F.col("members")[0]["source_host"].alias("source_host"),
        F.transform("members", lambda m: m["finding_uuid"]).alias("finding_ids"),
        F.transform("members", lambda m: m["rule_id"]).alias("rule_ids"),
    )


@query
def c08_time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-event rule by host alone: only hosts whose first findings lie within an hour pass."""
    rule = dataclasses.replace(ENCODED_EXECUTION, group_by=("source_host",), window_seconds=3600)
    return _matches(same_event_groups(findings_of(spark, sf_dir), rule, 0), rule)


def _all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate_new(findings_of(spark, sf_dir), BUILTIN_CORRELATION_RULES, stamp=tel.commit_time)


@query
def c09_match_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_matches(spark, sf_dir).drop("arrival_seq", "rule_pos")


@query
def c10_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = refs(findings_of(spark, sf_dir)).withColumn(
        "event_record_id", F.when(F.col("event_record_id") % 9 != 0, F.col("event_record_id"))
    )
    return rows.select("finding_uuid", event_key(F.struct(*rows.columns)).alias("event_key"))


@query
def c11_correlation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = refs(findings_of(spark, sf_dir))
    key = F.array(event_key(F.struct(*rows.columns)))
    return rows.select(
        "finding_uuid",
        correlation_key(F.lit("TP-CORR-WIN-0002"), F.lit(1), F.col("source_host"), key).alias("correlation_key"),
    )


@query
def c12_insert_new_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a full-history run that the live run has not stored, each once."""
    findings = findings_of(spark, sf_dir)
    history = match_rows(full_history_groups(findings, HOURLY, 0), [HOURLY], tel.commit_time)
    live = match_rows(anchored_groups(findings, [HOURLY]), [HOURLY], tel.commit_time)
    fresh = insert_new_matches(history.unionByName(history), live)
    return fresh.select("correlation_uuid", "correlation_key", "source_host", "last_event_time")


@query
def c13_new_finding_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only findings of the second half of the period are new; the rest is history."""
    findings = findings_of(spark, sf_dir)
    cut = F.col("event_time") >= F.lit("2024-01-16 00:00:00").cast("timestamp")
    return _matches(anchored_groups(findings.filter(cut), [HOURLY], findings.filter(~cut)), HOURLY)


@query
def c14_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_counts(findings_of(spark, sf_dir), [*BUILTIN_CORRELATION_RULES, HOURLY])


@query
def c15_faulty_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = events_of(spark, sf_dir).select(
        F.col("event_id").alias("rule_no"),
        F.expr("CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('C-', event_id div 2) END").alias("rule_id"),
        F.expr("CAST((event_id div 3) % 5 AS INT)").alias("rule_version"),
        F.expr("CASE WHEN event_id % 13 = 0 THEN 'severe' ELSE 'high' END").alias("severity"),
        F.expr("CASE WHEN event_id % 6 = 0 THEN 'sequence' WHEN event_id % 2 = 1 THEN 'same_event' ELSE 'temporal_count' END").alias("mode"),
        F.expr("slice(array('A', 'B', 'A'), 1, CAST(event_id % 4 AS INT))").alias("required"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN array() WHEN event_id % 7 = 1 THEN array('source_host', 'title') ELSE array('source_host') END").alias("group_by"),
        F.expr("event_id % 11 * 60").alias("window_seconds"),
        F.expr("event_id % 5 - 1").alias("minimum_matches"),
    )
    return rule_checks.faulty_correlation_rules(rules)


@query
def c16_encoded_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(anchored_groups(findings_of(spark, sf_dir), [ENCODED_EXECUTION]), ENCODED_EXECUTION)


@query
def c17_repeated_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_matches(spark, sf_dir).filter(F.col("rule_id") == REPEATED_ENCODED.rule_id).select(
        "correlation_uuid", "title", "severity", "source_host", "evidence", "tags"
    )


# ---------------------------------------------------------------- risk and alerts


def _minute_of_match() -> Column:
    return F.minute("last_event_time")


def _swing() -> Column:
    """A test provider: up to three contributions between -120 and +115 by the minute of the match."""
    minute = _minute_of_match()
    evidence = F.struct(minute.alias("minute"))
    return F.transform(
        F.sequence(F.lit(1), F.lit(3)),
        lambda i: contribution("swing", "minute", (minute * 4 - 120) * F.when(i == 1, 1).otherwise(0), evidence),
    )


SWING = RiskProvider("swing", _swing)


@query
def r01_base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir)
    level = F.col("record_id") % 5
    severity = reduce(
        lambda acc, pair: F.when(level == pair[0], pair[1]).otherwise(acc),
        enumerate(("informational", "low", "medium", "high", "critical")),
        F.lit(None),
    )
    return rows.select("record_id", RiskPolicy().base_score(severity).alias("base_score"))


@query
def r02_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table_of(spark, sf_dir, "correlation_matches")
    scored = assess(matches, providers=(SWING, REPEATED_ACTIVITY), stamp=tel.commit_time)
    return scored.select("correlation_uuid", F.posexplode("contributions").alias("place", "c")).select(
        "correlation_uuid", "place", "c.provider", "c.reason", "c.score_delta", "c.evidence"
    )


@query
def r03_repeated_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "risk_assessments").select("correlation_uuid", "contributions")


@query
def r04_clamped_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table_of(spark, sf_dir, "correlation_matches")
    return assess(matches, providers=(SWING,), stamp=tel.commit_time).select("correlation_uuid", "score")


@query
def r05_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("record_id") % 260 - 80
    rows = normalized_of(spark, sf_dir).select(score.alias("score"))
    return rows.groupBy(RiskPolicy().level_of(F.col("score")).alias("level")).agg(F.count("*").alias("scores"))


@query
def r06_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "risk_assessments").drop("contributions")


@query
def r07_contribution_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_of(spark, sf_dir)
    item = contribution("level", F.concat(F.lit("level "), F.col("raw.level")), F.col("raw.level"))
    return rows.select("record_id", item.alias("item"))


@query
def a01_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table_of(spark, sf_dir, "correlation_matches")
    scored = assess(matches, providers=(SWING,), stamp=tel.commit_time)
    return raise_alerts(scored, AlertPolicy(70), tel.commit_time).select("correlation_uuid", "risk_score")


@query
def a02_alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "alerts").select("alert_uuid", "title", "summary")


@query
def a03_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(spark, sf_dir, "alerts")


@query
def a05_chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(normalized_of(spark, sf_dir), SETTINGS).counts()


@query
def a06_full_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with a low-severity rule: assessed, but below the alert threshold."""
    low = dataclasses.replace(HOURLY, rule_id="T-CORR-LOW", severity="low")
    settings = dataclasses.replace(SETTINGS, correlation_rules=(ENCODED_EXECUTION, low))
    chain = process(normalized_of(spark, sf_dir), settings)
    scored = chain.assessments.groupBy("correlation_rule_id").agg(F.count("*").alias("assessments"))
    alerted = chain.alerts.groupBy("correlation_rule_id").agg(F.count("*").alias("alerts"))
    return scored.join(alerted, "correlation_rule_id", "left").fillna(0, ["alerts"])


# ---------------------------------------------------------------- telemetry queries


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel.log_events(events_of(spark, sf_dir))


def _processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel.process_events(events_of(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel.host_metrics(events_of(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collector run per host and hour of the events."""
    rows = normalized_of(spark, sf_dir)
    started = F.date_trunc("hour", "time_created").alias("started_at")
    failed = F.sum((F.col("severity") == "Critical").cast("int")) > F.count("*") / 2
    return (
        rows.groupBy(F.col("computer").alias("source_host"), started)
        .agg(
            F.when(failed, "failed").otherwise("success").alias("status"),
            F.count("*").cast("int").alias("events_inserted"),
            F.max("time_created").alias("finished_at"),
        )
        .withColumn("error_message", F.when(F.col("status") == "failed", "too many critical events"))
    )


@query
def q01_latest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.latest_logs(_logs(spark, sf_dir))


@query
def q02_logs_of_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.logs_of_provider(_logs(spark, sf_dir), "windows-power")


@query
def q03_logs_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.logs_of_event(_logs(spark, sf_dir), 4624)


@query
def q04_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.event_counts(_logs(spark, sf_dir))


@query
def q05_search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.search_logs(_logs(spark, sf_dir), "user1_ hashes")


@query
def q05b_search_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.search_logs(_logs(spark, sf_dir), "C:\\\\Program \\Files\\\\powershell")


@query
def q06_logs_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.logs_of_source(_logs(spark, sf_dir), "WINDOWS\\_s%y")


@query
def q07_latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.metric_list(_metrics(spark, sf_dir), 1)


@query
def q08_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tq.metric_list(_metrics(spark, sf_dir))


@query
def q09_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iq.list_detections(table_of(spark, sf_dir, "detection_findings"), "HOST-03", "medium", 25)


@query
def q10_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iq.list_correlations(table_of(spark, sf_dir, "correlation_matches"), "HOST-01", "medium", 50)


@query
def q11_risk_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iq.list_risk_assessments(table_of(spark, sf_dir, "risk_assessments"), level="critical", minimum_score=60)


@query
def q12_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iq.list_alerts(table_of(spark, sf_dir, "alerts"), "HOST-01", "new", "medium", 40, 10)


@query
def q13_alert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert with the lowest id, looked up by that id."""
    alerts = table_of(spark, sf_dir, "alerts")
    wanted = alerts.agg(F.min("alert_uuid")).head()[0]
    return iq.get_alert(alerts, wanted or "")


@query
def q14_no_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iq.list_alerts(table_of(spark, sf_dir, "alerts"), limit=500).select("alert_uuid", "created_at")


@query
def q16_response_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir)
    return rows.select(
        F.col("host_name").alias("host"),
        F.col("cpu_percent").cast("double").alias("cpu_percent"),
        time_text(F.col("boot_time")).alias("boot_time"),
        time_text(F.col("collected_at")).alias("collected_at"),
    )


# ---------------------------------------------------------------- analyst queries


def _plain(name: str, source: Callable[[SparkSession, str], DataFrame], report: Callable, *given) -> None:
    """Register a report over one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(source(spark, sf_dir), *given)

    run.__name__ = name
    query(run)


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table_of(spark, sf_dir, name)


def _alerts_in_all_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts after operators have worked on them."""
    minute = _minute_of_match()
    status = F.when(minute % 4 == 0, "acknowledged").when(minute % 4 == 1, "resolved").when(
        minute % 4 == 2, "suppressed"
    ).otherwise("new")
    return table_of(spark, sf_dir, "alerts").withColumn("status", status)


_FINDINGS, _MATCHES = _table("detection_findings"), _table("correlation_matches")
_RISKS, _ALERTS = _table("risk_assessments"), _table("alerts")

_plain("b01_recent_logs", _logs, tq.recent_logs)
_plain("b02_logs_by_source", _logs, tq.logs_by_source)
_plain("b03_logs_by_provider", _logs, tq.logs_by_provider)
_plain("b04_logs_by_event_id", _logs, tq.logs_by_event_id)
_plain("b05_latest_metrics", _metrics, tq.latest_metrics)
_plain("b06_high_memory", _metrics, tq.high_usage, "memory_percent")
_plain("b07_high_disk", _metrics, tq.high_usage, "disk_percent")
_plain("b08_recent_processes", _processes, tq.recent_processes)
_plain("b09_powershell_processes", _processes, tq.powershell_processes)
_plain("b10_collector_history", _runs, tq.collector_history)
_plain("b11_recent_findings", _FINDINGS, iq.recent_findings_report)
_plain("b12_finding_counts", _FINDINGS, iq.finding_counts)
_plain("b13_recent_encoded_findings", _FINDINGS, iq.recent_findings_of_rule)
_plain("b14_recent_matches", _MATCHES, iq.recent_matches)
_plain("b15_match_counts", _MATCHES, iq.match_counts)
_plain("b16_recent_assessments", _RISKS, iq.recent_assessments)
_plain("b17_highest_risk", _RISKS, iq.highest_risk)
_plain("b18_assessment_counts", _RISKS, iq.assessment_counts)
_plain("b19_recent_alerts", _ALERTS, iq.recent_alerts)
_plain("b20_open_alerts", _alerts_in_all_states, iq.open_alerts)
_plain("b21_alerts_by_status", _alerts_in_all_states, iq.alert_counts_by_status)
_plain("b22_alerts_by_level", _ALERTS, iq.alert_counts_by_level)


@query
def b23_investigation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iq.investigation_chain(_ALERTS(spark, sf_dir), _RISKS(spark, sf_dir), _MATCHES(spark, sf_dir))


_plain("b24_activity_by_host", _ALERTS, iq.activity_by_host)


@query
def b25_existing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the three stored tables are known to the catalog as views."""
    for name in ("correlation_matches", "alerts"):
        table_of(spark, sf_dir, name).createOrReplaceTempView(f"stored_{name}")
    names = ("stored_correlation_matches", "stored_risk_assessments", "stored_alerts")
    alerts = table_of(spark, sf_dir, "alerts")
    return alerts.agg(F.count("*").alias("alerts"), *iq.existing_tables(spark, names))


_plain("b26_latest_events", _logs, tq.recent_logs, 50, "time_created")
_plain("b27_recent_processes_by_creation", _processes, tq.recent_processes_by_creation)
_plain("b28a_findings_with_evidence", _FINDINGS, iq.recent_findings_with_evidence)
_plain("b28b_matches_with_evidence", _MATCHES, iq.recent_matches_with_evidence)
_plain("b28c_assessments_with_evidence", _RISKS, iq.recent_assessments_with_evidence)
_plain("b28d_recent_alerts_short", _ALERTS, iq.recent_alerts_short)
_plain("b28e_collector_health", _runs, tq.collector_history, 20)


# ---------------------------------------------------------------- data quality


def _doubtful_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, with values outside the domains on some of them."""
    number = F.col("event_record_id")
    return findings_of(spark, sf_dir).withColumns(
        {
            "severity": F.when(number % 5 == 0, "Severe").otherwise(F.col("severity")),
            "rule_version": F.when(number % 11 == 0, 0).otherwise(F.col("rule_version")),
            "title": F.when(number % 13 != 0, F.col("title")),
            "finding_uuid": F.when(number % 17 == 0, "copy").otherwise(F.col("finding_uuid")),
        }
    )


def _doubtful_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = _minute_of_match()
    return table_of(spark, sf_dir, "alerts").withColumns(
        {
            "risk_score": F.when(minute % 5 == 0, 101).otherwise(F.col("risk_score")),
            "risk_level": F.when(minute % 7 == 0, "supercritical").otherwise(F.col("risk_level")),
            "status": F.when(minute % 3 == 0, "open").otherwise(F.col("status")),
        }
    )


@query
def v01_severity_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful_findings(spark, sf_dir)
    return quality.rejected_rows(rows, [quality.severity_domain()]).select(
        "rule_id", "event_record_id", "severity", "violations"
    )


@query
def v02_rule_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful_findings(spark, sf_dir)
    return quality.accepted_rows(rows, [quality.positive_version()]).select("rule_id", "event_record_id")


@query
def v03_score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful_alerts(spark, sf_dir)
    return quality.rejected_rows(rows, [quality.score_range("risk_score")]).select("alert_uuid", "risk_score")


@query
def v04_level_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [quality.level_domain("risk_level"), quality.status_domain()]
    return quality.rejected_rows(_doubtful_alerts(spark, sf_dir), checks).select("alert_uuid", "violations")


@query
def v05_required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doubtful_findings(spark, sf_dir)
    marked = quality.marked(rows, quality.table_checks("detection_findings"))
    return marked.groupBy(F.array_join("violations", ",").alias("violated")).agg(F.count("*").alias("findings"))


@query
def v06_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeated_ids(_doubtful_findings(spark, sf_dir), "finding_uuid")


@query
def v06b_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.unique_by(_doubtful_findings(spark, sf_dir), "finding_uuid", ["arrival_seq", "rule_id"])
    return rows.select("finding_uuid", "rule_id", "event_record_id")


@query
def v07_partial_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_findings_of(spark, sf_dir).withColumn(
        "event_record_id", F.when(F.col("event_record_id") % 9 != 0, F.col("event_record_id"))
    )
    return quality.repeated_keys(rows, ["rule_id", "source_host", "event_record_id"], "event_record_id")


@query
def v08_read_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.read_contract(table_of(spark, sf_dir, "alerts"), "alerts").select(
        "alert_uuid", "risk_score", "risk_level", "status"
    )


@query
def r08_faulty_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contribution for each event; providers are numbered by user, some share a name or have none."""
    events = events_of(spark, sf_dir)
    name = "CASE WHEN provider_no % 11 = 0 THEN ' ' WHEN provider_no % 7 = 1 THEN concat('pair ', provider_no div 2) ELSE concat('provider ', provider_no - provider_no % 5 div 4) END"
    providers = events.select((F.col("user_id") % 100).alias("provider_no")).distinct().withColumn("name", F.expr(name))
    given = events.select(F.col("event_id").alias("contribution_no"), (F.col("user_id") % 103).alias("provider_no"))
    provider = F.when(F.col("contribution_no") % 17 == 0, F.lit("other")).otherwise(F.expr(name))
    return rule_checks.faulty_contributions(given.withColumn("provider", provider), providers)


@query
def r09_faulty_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = events_of(spark, sf_dir).selectExpr(
        "event_id AS policy_no", "event_id % 4 * 10 AS minimum_score", "100 - event_id % 5 * 25 AS maximum_score",
        "19 + event_id % 3 AS informational_max", "39 - event_id % 23 AS low_max", "59 AS medium_max", "79 + event_id % 31 AS high_max",
    )
    return rule_checks.faulty_risk_policies(policies)


@query
def a04_faulty_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = "CASE event_id % 9 WHEN 0 THEN 'true' WHEN 1 THEN '40.5' WHEN 2 THEN '-1' WHEN 3 THEN '101' WHEN 4 THEN NULL ELSE CAST(event_id % 103 AS STRING) END"
    return rule_checks.faulty_alert_thresholds(events_of(spark, sf_dir).selectExpr("event_id AS policy_no", f"{given} AS minimum_score"))


@query
def q15_faulty_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events_of(spark, sf_dir).selectExpr(
        "event_id AS request_no",
        "CASE event_id % 6 WHEN 0 THEN 'limit' WHEN 1 THEN 'minimum_score' WHEN 2 THEN 'severity' WHEN 3 THEN 'risk_level' WHEN 4 THEN 'status' ELSE 'page' END AS name",
        "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 6 < 2 THEN CAST(event_id % 700 - 5 AS STRING) WHEN event_id % 4 = 0 THEN 'new' WHEN event_id % 4 = 1 THEN 'open' ELSE 'high' END AS value",
    )
    return rule_checks.faulty_parameters(requests)


# ---------------------------------------------------------------- streaming

_STREAMED: dict[tuple[str, str, str], str] = {}


def streamed(spark: SparkSession, sf_dir: str, order: str = "in_order") -> TableStore:
    """The documents as a stream of three parts, one per micro-batch, with a restart after each.

    ``late`` sends the last third before the second one.
    """
    key = (spark.sparkContext.applicationId, sf_dir, order)
    if key not in _STREAMED:
        inbox, root = scratch_path(spark, "inbox"), scratch_path(spark, "streamed")
        documents = documents_of(spark, sf_dir)
        top = documents.agg(F.max("arrival_seq")).head()[0]
        third = F.expr(f"arrival_seq * 3 div {top + 1}")
        ingestion = Ingestion(spark, root, DEFAULT_HOST, SETTINGS)
        for number in (0, 1, 2) if order == "in_order" else (0, 2, 1):
            documents.filter(third == number).select("channel", "xml").write.mode("append").parquet(inbox)
            stream = spark.readStream.schema("channel STRING, xml STRING").parquet(inbox)
            ingestion.start(stream, f"{root}/progress", None).awaitTermination()
        _STREAMED[key] = root
    return TableStore(spark, _STREAMED[key])


@query
def t01_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = streamed(spark, sf_dir).read("log_events")
    return logs.groupBy("batch_id").agg(F.count("*").alias("events"))


@query
def t02_resumed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the stream, which was stopped and resumed between the files."""
    return streamed(spark, sf_dir).table("detection_findings").select(
        "finding_uuid", "rule_id", "source_host", "event_record_id", "event_time"
    )


@query
def t03_stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir).table("correlation_matches").select(
        "correlation_key", "rule_id", "source_host", "first_event_time", "last_event_time"
    )


@query
def t03b_stateful_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches from a stream of findings in three parts, with the look-back as state."""
    inbox, found = scratch_path(spark, "findings"), scratch_path(spark, "found")
    # Four passes follow; the findings are derived once.
    staged = scratch_path(spark, "all-findings")
    found_once = findings_of(spark, sf_dir).select(*REF_FIELDS)
    found_once.write.parquet(staged)
    findings = spark.read.schema(found_once.schema).parquet(staged)
    top = findings.agg(F.max("arrival_seq")).head()[0]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for number in range(3):
        findings.filter(F.expr(f"arrival_seq * 3 div {top + 1}") == number).write.mode("append").parquet(inbox)
        stream = correlate_stream(spark.readStream.schema(findings.schema).parquet(inbox), BUILTIN_CORRELATION_RULES)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{found}-progress").outputMode("append")
        writer.trigger(availableNow=True).start(found).awaitTermination()
    groups = spark.read.schema(stream.schema).parquet(found)
    matches = insert_new_matches(match_rows(groups, BUILTIN_CORRELATION_RULES, tel.commit_time))
    return matches.select("correlation_key", "rule_id", "source_host", "first_event_time", "last_event_time")


@query
def t04_late_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, "late").table("correlation_matches").select(
        "correlation_key", "rule_id", "source_host", "first_event_time", "last_event_time"
    )


@query
def t05_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table after everything was ingested a second time: only logs double."""
    store = ingested(spark, sf_dir)
    names = ("log_events", "detection_findings", "correlation_matches", "risk_assessments", "alerts")
    counts = [
        store.table(name).agg(F.count("*").alias("stored_rows")).withColumn("table_name", F.lit(name))
        for name in names
    ]
    return reduce(DataFrame.unionByName, counts)


# ---------------------------------------------------------------- extension points


@query
def u01_custom_detection_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = _rule(
        "X-0001", FieldCondition("raw.event_data.User", "ends_with_any", ("1", "3")),
        FieldCondition("severity", "equals", ("error", "warning")),
        source_type="powershell", event_id=4104, severity="critical",
    )
    return detect(normalized_of(spark, sf_dir), [rule], tel.commit_time).select(
        "rule_id", "severity", "event_record_id", "evidence"
    )


THREE_PER_SOURCE = dataclasses.replace(
    REPEATED_ENCODED, rule_id="X-CORR-0001", group_by=("source_host", "source_type"), minimum_matches=3,
    required_detection_rule_ids=("TP-WIN-SYSMON-0001",), window_seconds=7200,
)


@query
def u02_custom_correlation_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(anchored_groups(findings_of(spark, sf_dir), [THREE_PER_SOURCE]), THREE_PER_SOURCE)


@query
def u03_custom_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    night = RiskProvider(
        "night",
        lambda: F.when(
            F.hour("last_event_time") < 6,
            F.array(contribution("night", "activity at night", 10, F.struct(F.hour("last_event_time").alias("hour")))),
        ),
    )
    matches = table_of(spark, sf_dir, "correlation_matches")
    scored = assess(matches, providers=(*BUILTIN_PROVIDERS, night), stamp=tel.commit_time)
    return scored.groupBy("correlation_rule_id", "score", "level").agg(F.count("*").alias("assessments"))


@query
def u04_custom_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = RiskPolicy(maximum_score=90, informational_max=10, low_max=35, medium_max=39, high_max=64)
    matches = table_of(spark, sf_dir, "correlation_matches")
    alerts = raise_alerts(assess(matches, policy, stamp=tel.commit_time), AlertPolicy(50), tel.commit_time)
    return alerts.groupBy("risk_level", "risk_score").agg(F.count("*").alias("alerts"))
