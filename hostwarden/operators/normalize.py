"""From parsed event XML to normalized events and the stored telemetry tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.functions import windows_xml as wx
from hostwarden.functions.text import sha256_of
from hostwarden.operators.ranking import global_positions

CHANNEL_KEY = ("source_type", "channel")
ARRIVAL_ORDER = ["ordinal", "record_id", "_tie"]


def normalize(
    documents: DataFrame, default_computer: str, batch_time: Column | None = None, keep: bool = False
) -> DataFrame:
    """Parse a column of XML documents into normalized events.

    ``documents`` has ``xml`` (text) or ``parsed`` (from the XML scan); all other
    columns are carried along. Besides the normalized fields the result has
    ``is_bad``: malformed XML, or an event or record id that is no whole number.
    ``batch_time`` stands in for a missing event time. ``keep`` adds the text ``document``
    and, for bad ones, a ``reason`` (``malformed`` or ``bad_number``).
    """
    if "parsed" not in documents.columns:
        documents = _evaluated(documents, wx.parse_event_xml(F.col("xml")), "parsed")
    carried = [name for name in documents.columns if name not in ("xml", "parsed")]
    now = F.current_timestamp() if batch_time is None else batch_time
    system = F.col("parsed.System")
    original = F.col("xml") if "xml" in documents.columns else F.col("parsed._corrupt_record")
    kept = [original.alias("document")] if keep else []
    # Flat columns first: only these pass the generators below.
    flat = documents.select(
        *carried,
        F.coalesce(system["Provider"]["_Name"], F.lit("")).alias("provider"),
        wx.text_or(system["EventID"], "0").alias("_event_id"),
        wx.text_or(system["EventRecordID"], "0").alias("_record_id"),
        wx.text_or(system["Level"], "4").alias("level"),
        wx.text_or(system["Computer"], default_computer).alias("computer"),
        F.nullif(system["TimeCreated"]["_SystemTime"], F.lit("")).alias("_created"),
        F.col("parsed.EventData.Data").alias("_data"),
        F.col("parsed.UserData").alias("_markup"),
        (F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull()).alias("_malformed"),
        *kept,
    )
    paired = _evaluated(flat, wx.event_data_pairs(F.col("_data")), "_pairs")
    text = _evaluated(paired, wx.settle_pairs(F.col("_pairs")), "_entries").withColumn(
        "_user", wx.user_data_parts(F.col("_markup"))
    )
    typed = text.select(
        *carried,
        "provider",
        F.expr("try_cast(trim(_event_id) AS BIGINT)").alias("event_id"),
        F.expr("try_cast(trim(_record_id) AS BIGINT)").alias("record_id"),
        "level",
        "computer",
        F.expr("try_cast(_created AS TIMESTAMP)").alias("_time"),
        "_created",
        "_entries",
        "_user",
        "_malformed",
        *(["document"] if keep else []),
    )
    message = (
        F.when(F.size("_entries") > 0, wx.entries_text(F.col("_entries")))
        .otherwise(F.coalesce(F.col("_user.message"), F.lit("")))
    )
    is_bad = (
        F.col("_malformed")
        | _bad_process_id(carried)
        | F.col("event_id").isNull()
        | F.col("record_id").isNull()
        | (F.col("_created").isNotNull() & F.col("_time").isNull())
    )
    return typed.select(
        *carried,
        "provider",
        "event_id",
        "record_id",
        wx.severity_name(F.col("level")).alias("severity"),
        F.coalesce("_time", now).alias("time_created"),
        "computer",
        message.alias("message"),
        F.struct(
            "provider",
            "event_id",
            "record_id",
            "level",
            "computer",
            F.map_from_entries("_entries").alias("event_data"),
            F.parse_json(F.coalesce(F.col("_user.document"), F.lit("{}"))).alias("user_data"),
        ).alias("raw"),
        is_bad.alias("is_bad"),
        *(["document", _reason(is_bad)] if keep else []),
    )


def _reason(is_bad: Column) -> Column:
    return F.when(F.col("_malformed"), "malformed").when(is_bad, "bad_number").alias("reason")


def _evaluated(rows: DataFrame, expression: Column, name: str) -> DataFrame:
    """Add a column through a generator.

    Filters and projections further up then read its value. Without this the
    optimizer would copy the expression into each of them and parse the same
    document many times.
    """
    return rows.select("*", F.explode(F.array(expression)).alias(name))


def _bad_process_id(carried: list[str]) -> Column:
    """A process event whose ProcessId is no whole number cannot be stored."""
    if "source_type" not in carried:
        return F.lit(False)
    given = F.expr("nullif(get(filter(_entries, e -> e.key = 'ProcessId'), 0).value, '')")
    is_process = (F.col("source_type") == "sysmon") & (F.col("event_id") == 1)
    unreadable = given.isNotNull() & given.try_cast("bigint").isNull()
    return F.coalesce(is_process & unreadable, F.lit(False))


def accepted(normalized: DataFrame, strict: bool = False) -> DataFrame:
    """Events that are stored.

    By default a bad document is left out alone. ``strict`` drops every event of
    a channel that holds a bad one, because that channel's batch fails as a
    whole. The bad channels are found by a partial aggregate and taken out by an
    anti join on at most one row per channel, so a big channel is never gathered.
    """
    good = normalized.filter(~F.col("is_bad")).drop("is_bad")
    if not strict:
        return good
    return good.join(_broken(normalized), list(CHANNEL_KEY), "left_anti")


def _broken(normalized: DataFrame) -> DataFrame:
    return normalized.filter("is_bad").select(*CHANNEL_KEY).distinct()


def rejected(normalized: DataFrame, strict: bool = False) -> DataFrame:
    """Bad documents, for the reject table; with ``strict`` also the others of their channels."""
    bad = normalized.filter("is_bad").drop("is_bad")
    if not strict:
        return bad
    others = normalized.filter(~F.col("is_bad")).drop("is_bad")
    others = others.join(_broken(normalized), list(CHANNEL_KEY), "left_semi")
    return bad.unionByName(others.withColumn("reason", F.lit("strict_channel")))


def _tie(events: DataFrame) -> Column:
    """A hash of what an event says: orders equal record ids, alike in a repeated batch."""
    told = [c for c in ("computer", "provider", "event_id", "time_created", "message") if c in events.columns]
    return F.xxhash64(*told) if told else F.lit(0).cast("bigint")


def with_arrival(events: DataFrame, offset: int = 0) -> DataFrame:
    """Number the events in the order they are processed.

    Channels go in registry order (``ordinal``) and each channel by record id, equal
    ones by a hash of what the event says, so that a repeated batch has the same numbers.
    ``repartitionByRange`` sorts in parallel; only one count per partition is
    needed to turn the places inside the partitions into one sequence.
    """
    numbered = global_positions(events.withColumn("_tie", _tie(events)), ARRIVAL_ORDER, "arrival_seq").drop("_tie")
    return numbered.withColumn("arrival_seq", F.col("arrival_seq") + F.lit(offset))


def arrival_order(events: DataFrame) -> Column:
    """The same order as a struct to compare, for rows that need no number yet."""
    return F.struct("ordinal", "record_id", _tie(events).alias("_tie"))


def with_arrival_numbers(rows: DataFrame, offset: int = 0) -> DataFrame:
    """Rows whose ``arrival_seq`` is an ``arrival_order`` -> numbers in that order; rows of one event share theirs.

    Only the distinct orders are sorted, not the rows.
    """
    orders = global_positions(rows.select("arrival_seq.*").distinct(), ARRIVAL_ORDER, "_number")
    flat = rows.select(*[c for c in rows.columns if c != "arrival_seq"], *[F.col(f"arrival_seq.{c}").alias(c) for c in ARRIVAL_ORDER])
    number = (F.col("_number") + F.lit(offset)).alias("arrival_seq")
    return flat.join(orders, ARRIVAL_ORDER).select(*[number if c == "arrival_seq" else F.col(c) for c in rows.columns])


def raw_json(raw: str = "raw") -> Column:
    """The raw payload as JSON text with all keys in sorted order."""
    entries = F.array_sort(F.map_entries(F.col(f"{raw}.event_data")))
    names = ("computer", "event_data", "event_id", "level", "provider", "record_id", "user_data")
    parts = {name: F.col(f"{raw}.{name}") for name in names}
    parts["event_data"] = F.map_from_entries(entries)
    return F.to_json(F.struct(*[parts[name].alias(name) for name in names]))


def to_log_events(
    events: DataFrame, default_host: str, stamp: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Log table rows. Only here an empty computer falls back to the collector host."""
    time = F.col("time_created")
    return events.select(
        F.coalesce(F.nullif("computer", F.lit("")), F.lit(default_host)).alias("source_host"),
        "source_type",
        F.col("provider").alias("provider_name"),
        "event_id",
        F.col("record_id").alias("event_record_id"),
        "severity",
        "time_created",
        "message",
        raw_json().alias("raw_data"),
        (F.current_timestamp() if stamp is None else stamp(time)).alias("inserted_at"),
    )


def to_process_events(
    events: DataFrame, stamp: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Process-creation rows: event id 1 of the sysmon source."""
    data = F.col("raw.event_data")
    time = F.col("time_created")

    def field(name: str) -> Column:
        return F.coalesce(data[name], F.lit(""))

    process_id = F.coalesce(F.nullif(data["ProcessId"], F.lit("")), F.lit("0"))
    return events.filter((F.col("source_type") == "sysmon") & (F.col("event_id") == 1)).select(
        F.coalesce("computer", F.lit("")).alias("source_host"),
        field("ProcessGuid").alias("process_guid"),
        F.trim(process_id).try_cast("bigint").alias("process_id"),
        field("Image").alias("image"),
        field("CommandLine").alias("command_line"),
        field("ParentImage").alias("parent_image"),
        field("ParentCommandLine").alias("parent_command_line"),
        field("User").alias("user_name"),
        sha256_of(field("Hashes")).alias("sha256"),
        time.alias("created_at"),
        (F.current_timestamp() if stamp is None else stamp(time)).alias("inserted_at"),
    )


def to_host_metrics(snapshots: DataFrame, batch_time: Column | None = None) -> DataFrame:
    """Metric rows; snapshots taken without the sampling library are skipped."""
    return snapshots.filter("psutil_available").select(
        F.col("host").alias("host_name"),
        F.col("cpu_percent").cast("double").alias("cpu_percent"),
        F.col("memory_percent").cast("double").alias("memory_percent"),
        F.col("disk_percent").cast("double").alias("disk_percent"),
        F.col("boot_time").cast("timestamp").alias("boot_time"),
        (F.current_timestamp() if batch_time is None else batch_time).alias("collected_at"),
    )
