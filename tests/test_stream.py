"""Ingestion in batches and as a stream over a small fixture."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostwarden.session import scratch_path
from hostwarden.sources.tables import TableStore
from hostwarden.sources.xml_events import stream_event_xml
from hostwarden.streaming.ingest import Ingestion

SYSMON = "Microsoft-Windows-Sysmon/Operational"


def document(record: int, seconds: int, host: str = "H1", command: str = "powershell.exe -enc x") -> str:
    moment = (datetime(2026, 1, 1) + timedelta(seconds=seconds)).isoformat()
    return (
        "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Provider Name='Sysmon'/>"
        f"<EventID>1</EventID><TimeCreated SystemTime='{moment}Z'/><EventRecordID>{record}</EventRecordID>"
        f"<Computer>{host}</Computer></System><EventData><Data Name='Image'>C:\\pwsh.exe</Data>"
        f"<Data Name='CommandLine'>{command}</Data></EventData></Event>"
    )


def batch(spark, *documents):
    return spark.createDataFrame([(SYSMON, xml) for xml in documents], "channel string, xml string")


def counts(store):
    names = ("log_events", "process_events", "detection_findings", "correlation_matches", "risk_assessments", "alerts")
    return [store.table(name).count() for name in names]


def test_batches_replays_and_failures(spark):
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR")
    store = ingestion.store
    ingestion.ingest(batch(spark, document(102, 300), document(101, 0), "<Event>"), 0)
    assert counts(store) == [2, 2, 4, 3, 3, 3]
    assert [tuple(r) for r in store.checkpoints().collect()] == [("sysmon", SYSMON, 102)]
    (run,) = store.table("collector_runs").collect()
    assert (run.status, run.events_inserted, run.rejected_count) == ("success", 2, 1)
    # The same documents once more: logs double, nothing new is derived.
    ingestion.ingest(batch(spark, document(102, 300), document(101, 0)), 1)
    assert counts(store) == [4, 4, 4, 3, 3, 3]
    # A repeated batch replaces itself.
    ingestion.ingest(batch(spark, document(102, 300), document(101, 0)), 1)
    assert counts(store) == [4, 4, 4, 3, 3, 3]
    # Look-back over stored findings: 300 and 850 are paired with the new one at 850.
    ingestion.ingest(batch(spark, document(103, 850)), 2)
    assert counts(store)[2:4] == [6, 5]
    # A failing batch is recorded and stays invisible.
    with pytest.raises(Exception):
        ingestion.ingest(batch(spark, document(104, 900)).drop("xml"), 3)
    assert counts(store)[0] == 5 and store.last_batch() == 2
    assert store.read("failed_runs", only=3).head().status == "failed"
    with pytest.raises(Exception):
        ingestion.ingest(batch(spark, document(104, 900)).drop("xml"), 3)
    runs = sorted(r.status for r in store.table("collector_runs").collect())
    assert runs == ["failed"] * 2 + ["success"] * 3
    # A batch above one that was never committed: the one below stays unseen.
    ingestion.ingest(batch(spark, document(105, 1500)), 4)
    store.write(store.read("log_events", only=4).drop("batch_id", "event_date"), "log_events", 3)
    assert counts(store)[0] == 6 and store.last_batch() == 4


def test_processed_records_can_be_skipped(spark):
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR", skip_processed=True, batch_size=2)
    documents = batch(spark, *[document(number, number) for number in (1, 2, 3)])
    for number, expected in enumerate((2, 3, 3)):
        ingestion.ingest(documents, number)
        assert ingestion.store.table("log_events").count() == expected


def test_stream_of_xml_files(spark, tmp_path):
    inbox = tmp_path / "inbox" / f"channel={SYSMON.replace('/', '%2F')}"
    inbox.mkdir(parents=True)
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR")
    progress = scratch_path(spark, "progress")
    for name, documents in (("a", [document(1, 0), document(2, 60, command="notepad")]), ("b", [document(3, 500)])):
        (inbox / f"{name}.xml").write_text("\n".join(documents))
        stream = stream_event_xml(spark, str(tmp_path / "inbox"), 1)
        ingestion.start(stream, progress, None).awaitTermination()
    assert counts(ingestion.store) == [3, 3, 5, 3, 3, 3]
    together = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR")
    together.ingest(batch(spark, document(1, 0), document(2, 60, command="notepad"), document(3, 500)), 0)
    keys = [sorted(r.correlation_key for r in i.store.table("correlation_matches").collect()) for i in (ingestion, together)]
    assert keys[0] == keys[1]


def test_metrics(spark):
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR")
    rows = spark.createDataFrame(
        [("h", True, 1.0, 2.0, 3.0, "2026-01-01")],
        "host string, psutil_available boolean, cpu_percent double, memory_percent double, disk_percent double, boot_time string",
    )
    ingestion.ingest_metrics(rows, 0)
    ingestion.ingest_metrics(rows, 1)
    assert ingestion.store.table("host_metrics").count() == 2


def test_rejects_keep_document_and_reason(spark):
    documents = batch(spark, document(1, 0), "<Event>", document(1, 5).replace("ID>1<", "ID>one<", 1))
    other = spark.createDataFrame([("Nowhere", document(9, 9)), (None, document(9, 9)), ("System", document(4, 4))], documents.schema)
    for strict, expected in (
        (False, ["bad_number", "malformed", "unknown_channel", "unknown_channel"]),
        (True, ["bad_number", "malformed", "strict_channel", "unknown_channel", "unknown_channel"]),
    ):
        ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR", sources=["sysmon"], strict=strict)
        ingestion.ingest(documents.union(other), 0)
        rejects = ingestion.store.rejected().collect()
        assert sorted(r.reason for r in rejects) == expected
        assert all(r.document and r.document.startswith("<Event") for r in rejects)
        (run,) = ingestion.store.table("collector_runs").collect()
        assert run.rejected_count == len(expected) and run.events_inserted == (0 if strict else 1)


def test_bad_documents_do_not_fill_a_batch_and_ties_stay_together(spark):
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR", skip_processed=True, batch_size=1)
    documents = batch(spark, "<Event>", "<Ev", document(7, 0, "A"), document(7, 1, "B"), document(8, 2))
    for number, expected in enumerate((2, 3, 3)):
        ingestion.ingest(documents, number)
        assert ingestion.store.table("log_events").count() == expected


def test_checkpoints_are_kept_by_host(spark):
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR", skip_processed=True)
    ingestion.ingest(batch(spark, document(100, 0, "A")), 0)
    ingestion.ingest(batch(spark, document(100, 0, "A"), document(5, 1, "B"), document(3, 2, "")), 1)
    store = ingestion.store
    assert sorted((r.source_host, r.event_record_id) for r in store.table("log_events").collect()) == [("A", 100), ("B", 5), ("COLLECTOR", 3)]
    last = {(r.source_host, r.last_record_id) for r in store.host_checkpoints().collect()}
    assert last == {("A", 100), ("B", 5), ("COLLECTOR", 3)}
    assert [tuple(r) for r in store.checkpoints().collect()] == [("sysmon", SYSMON, 100)]


def test_a_failed_repetition_changes_nothing(spark, monkeypatch):
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR")
    store = ingestion.store
    records = lambda: sorted(r.event_record_id for r in store.table("log_events").collect())
    ingestion.ingest(batch(spark, document(1, 0), document(2, 10)), 0)
    before = counts(store)

    def fail(*_):
        raise RuntimeError("after the log table")

    with monkeypatch.context() as patch:
        patch.setattr(ingestion, "store_intelligence", fail)
        with pytest.raises(RuntimeError):
            ingestion.ingest(batch(spark, document(9, 0)), 0)
    assert records() == [1, 2] and counts(store) == before
    runs = sorted((r.status, r.events_inserted) for r in store.table("collector_runs").collect())
    assert runs == [("failed", 0), ("success", 2)]
    # The next attempt that commits takes the place of all tables of the batch, of its run, too.
    ingestion.ingest(batch(spark, document(9, 0)), 0)
    assert records() == [9] and counts(store)[2] == 2
    assert sorted(r.status for r in store.table("collector_runs").collect()) == ["failed", "success"]
    assert not store.exists("staged/batch_id=0/attempt=direct")


def test_rejects_are_stored_once(spark):
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR", skip_processed=True)
    documents = batch(spark, "<Event>", "<Event>", document(1, 0), None)
    for number in (0, 1):
        ingestion.ingest(documents, number)
        # Two documents with one text are two documents; the second batch brings nothing new.
        assert ingestion.store.rejected().count() == 3 and ingestion.store.table("log_events").count() == 1
    runs = sorted((r.events_inserted, r.rejected_count) for r in ingestion.store.table("collector_runs").collect())
    assert runs == [(0, 0), (1, 3)]


def test_metrics_and_empty_polls_are_runs(spark):
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR")
    snapshots = spark.createDataFrame(
        [("h", True, 1.0, 2.0, 3.0, "2026-01-01"), ("h", False, 1.0, 2.0, 3.0, "2026-01-01")],
        "host string, psutil_available boolean, cpu_percent double, memory_percent double, disk_percent double, boot_time string",
    )
    ingestion.ingest(batch(spark, document(1, 0)), 0, snapshots)
    ingestion.ingest(batch(spark, document(1, 0)).limit(0), 1)
    ingestion.ingest_metrics(snapshots, 0)
    assert ingestion.store.table("host_metrics").count() == 2
    assert sorted(r.events_inserted for r in ingestion.store.table("collector_runs").collect()) == [0, 2]
    assert ingestion.store.last_batch() == 1 and ingestion.store.host_checkpoints().count() == 1


def test_history_days_prune_the_stored_side(spark):
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR", history_days=1)
    ingestion.ingest(batch(spark, document(1, 0), document(2, 10)), 0)
    first = datetime(2026, 1, 3)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for table in ("detection_findings", "correlation_matches"):
        stored = ingestion._within(ingestion.store.read(table, before=1), first, first)
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ >= ", plan) and stored.count() == 0
    ingestion.ingest(batch(spark, document(1, 0), document(3, 20)), 1)
    assert counts(ingestion.store)[2] == 6


def test_order_of_arrival_is_that_of_the_numbered_events(spark):
    """Findings are numbered alone, in the order that numbering all events would give; one event has one number."""
    ingestion = Ingestion(spark, scratch_path(spark, "test"), "COLLECTOR")
    documents = batch(spark, document(7, 0, "A"), document(3, 50), document(5, 20, command="notepad"), document(3, 5, "B"))
    ingestion.ingest(documents, 2)
    rows = sorted((r.arrival_seq, r.event_record_id, r.rule_id) for r in ingestion.store.table("detection_findings").collect())
    assert [record for _, record, _ in rows] == [3, 3, 3, 3, 5, 7, 7]
    assert [number - (2 << 40) for number, *_ in rows] == [0, 0, 1, 1, 2, 3, 3]


def test_rows_that_come_by_day_are_not_shuffled(spark):
    """Files of few days each are written as they are, mixed ones by day; the rows are the same."""
    store, spread = TableStore(spark, scratch_path(spark, "days")), {}
    days = spark.range(400).select(F.timestamp_seconds(F.col("id") * 8640).alias("time_created"), "id")
    for batch_id, rows in enumerate((days.repartitionByRange(8, "time_created"), days.repartition(8, "id"))):
        attempt = store.attempt(batch_id)
        staged = attempt.stage(rows, "events")
        by_day = attempt.comes_by_day(staged, "time_created")
        attempt.write(staged.select("time_created", F.col("id").alias("event_record_id")), "log_events", by_day)
        written = store.read("log_events", only=batch_id)
        spread[by_day] = (written.count(), len(written.inputFiles()))
    assert spread.keys() == {True, False} and {n for n, _ in spread.values()} == {400} and spread[True][1] <= 2 * 48
