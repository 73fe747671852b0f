"""From event documents to the stored tables, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hostwarden.operators import normalize as nz
from hostwarden.operators.alerts import raise_alerts
from hostwarden.operators.correlate import look_back_seconds
from hostwarden.operators.detect import finding_keys, with_rule_texts
from hostwarden.operators.findings import FINDING_KEY, first_arrivals
from hostwarden.operators.risk import assess
from hostwarden.plans.chain import Settings, correlate_new
from hostwarden.schemas import COLLECTOR_RUNS, REJECTED_EVENTS, columns_of
from hostwarden.sources.checkpoints import advance_checkpoints, after_checkpoint, next_batch
from hostwarden.sources.registry import SOURCES, resolve_sources, source_table
from hostwarden.sources.tables import FAILED_RUNS, REJECTED, Attempt, TableStore

# Arrival numbers of a batch start at its id times this.
ARRIVALS_PER_BATCH = 1 << 40


class Ingestion:
    """Writes what a batch of events yields into all tables.

    The parsed events are staged once and every later step reads the columns it needs from
    there, or what the step before has written, so a lost executor costs one step and nothing is
    computed twice. Only findings are put in order of arrival, not the events.

    A batch is one attempt that becomes visible as a whole (see ``TableStore``). Repeating a
    batch gives the same rows: ids derive from natural keys, and stored rows count only up to
    the batch before.

    ``skip_processed`` leaves out documents that an earlier batch has stored, by the
    checkpoint of their host and channel, or rejected, by a hash of the document.
    ``history_days`` bounds how many days before the events of a batch a stored finding or
    match may lie to count as the same one; None compares with all of them.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        hostname: str,
        settings: Settings = Settings(),
        sources: Sequence[str] | None = None,
        batch_time: datetime | None = None,
        strict: bool = False,
        skip_processed: bool = False,
        batch_size: int | None = None,
        history_days: int | None = None,
    ) -> None:
        self.spark, self.settings, self.hostname = spark, settings, hostname
        self.store = TableStore(spark, root)
        self.sources = resolve_sources(sources)
        self.batch_time, self.strict = batch_time, strict
        self.skip_processed, self.batch_size = skip_processed, batch_size
        self.history_days = history_days

    def _now(self):
        return F.current_timestamp() if self.batch_time is None else F.lit(self.batch_time)

    def prepare(self, documents: DataFrame, batch_id: int) -> DataFrame:
        """The parsed events of a batch, at most ``batch_size`` good ones of a channel."""
        events = self._parsed(documents, batch_id)
        return events if self.batch_size is None else next_batch(events, self.batch_size)

    def _parsed(self, documents: DataFrame, batch_id: int) -> DataFrame:
        """Parsed events of the enabled channels, good and bad, with their host.

        Documents of registered channels that are not enabled are left out; those of a
        channel that is not registered at all are bad, with the reason ``unknown_channel``.
        ``documents`` has ``channel`` and either ``xml`` or ``parsed``.
        """
        channels = source_table(self.spark, self.sources).filter("channel IS NOT NULL")
        lookup = channels.select("source_type", "channel", "ordinal")
        named = documents.drop("source_type", "arrival_seq").join(F.broadcast(lookup), "channel", "left")
        unknown = F.col("source_type").isNull()
        registered = [channel for _, names in SOURCES.values() for channel in names]
        known = named.filter(~unknown | ~F.coalesce(F.col("channel").isin(*registered), F.lit(False)))
        events = nz.normalize(known, self.hostname, self._now(), keep=True)
        events = events.withColumn("is_bad", F.col("is_bad") | unknown)
        events = events.withColumn("reason", F.when(unknown, "unknown_channel").otherwise(F.col("reason")))
        # Only rejects are known by a hash; with ``strict`` any document may become one.
        known_by = _document_hash() if self.strict else F.when(F.col("is_bad"), _document_hash())
        events = self._with_host(events).withColumn("document_hash", known_by)
        if not self.strict:
            # The texts of good documents need not travel on.
            events = events.withColumn("document", F.when(F.col("is_bad"), F.col("document")))
        if self.skip_processed:
            events = after_checkpoint(events, self.store.host_checkpoints(batch_id))
        return events

    def _with_host(self, events: DataFrame) -> DataFrame:
        """``source_host``: where the record ids count. An empty computer is the collector's."""
        return events.withColumn("source_host", F.coalesce(F.nullif("computer", F.lit("")), F.lit(self.hostname)))

    def ingest(self, documents: DataFrame, batch_id: int, snapshots: DataFrame | None = None) -> None:
        """One batch of documents, and of host metric snapshots if there are any, into all tables.

        The run is part of the batch and becomes visible with it. On failure nothing of the
        batch does, and a failed run is recorded. A batch without documents is a run, too.
        """
        attempt, started = self.store.attempt(batch_id), datetime.now(timezone.utc)
        try:
            inserted, bad = (0, 0) if documents.isEmpty() else self._store(documents, attempt)
            if snapshots is not None:
                self._store_metrics(snapshots, attempt)
                inserted += attempt.read("host_metrics").count()
            attempt.write(self._run("success", inserted, bad, started, None), "collector_runs")
            attempt.commit()
        except Exception as problem:
            attempt.write(self._run("failed", 0, 0, started, str(problem)), FAILED_RUNS)
            raise
        finally:
            attempt.clear()

    def _store(self, documents: DataFrame, attempt: Attempt) -> tuple[int, int]:
        """All tables of a batch of documents; how many were stored and how many rejected."""
        events = attempt.stage(self._parsed(documents, attempt.batch_id), "events")
        if self.batch_size is not None:
            # The limit looks for its last record ids first, so it reads parsed events, not documents.
            events = attempt.stage(next_batch(events, self.batch_size), "limited")
        by_day = attempt.comes_by_day(events, "time_created")
        rejects = nz.rejected(events, self.strict)
        if self.skip_processed and attempt.batch_id > 0:
            known = self.store.rejected(before=attempt.batch_id).select("document_hash")
            rejects = rejects.join(known, "document_hash", "left_anti")
        rejects = nz.with_arrival(rejects, attempt.batch_id * ARRIVALS_PER_BATCH)
        attempt.write(rejects.select(*columns_of(REJECTED_EVENTS)), REJECTED)
        good = nz.accepted(events, self.strict).drop("document", "reason", "document_hash")
        inserted = self.store_events(good, attempt, by_day)
        self.advance(good, attempt)
        return inserted, attempt.read(REJECTED).count()

    def store_events(self, events: DataFrame, attempt: Attempt, by_day: bool = False) -> int:
        """Telemetry and intelligence tables of normalized events; ``by_day`` as in ``TableStore.write``."""
        stamp = self.settings.stamp
        attempt.write(nz.to_log_events(events, self.hostname, stamp), "log_events", by_day)
        attempt.write(nz.to_process_events(events, stamp), "process_events", by_day)
        self.store_intelligence(events, attempt)
        return attempt.read("log_events").count()

    def store_intelligence(self, events: DataFrame, attempt: Attempt) -> None:
        """Findings, matches, assessments and alerts of a batch."""
        settings, batch_id = self.settings, attempt.batch_id
        attempt.write(with_rule_texts(self._new_findings(events, attempt), settings.detection_rules), "detection_findings")
        findings = attempt.read("detection_findings")
        history, stored = None, None
        if batch_id > 0:
            first, last = findings.agg(F.min("event_time"), F.max("event_time")).head()
            history = self._look_back(first, last, batch_id)
            stored = self._within(self.store.read("correlation_matches", before=batch_id), first, last)
        matches = correlate_new(findings, settings.correlation_rules, history, stored, settings.stamp)
        attempt.write(matches.drop("arrival_seq", "rule_pos"), "correlation_matches")
        assessments = assess(attempt.read("correlation_matches"), settings.risk_policy, settings.risk_providers, settings.stamp)
        attempt.write(assessments, "risk_assessments")
        attempt.write(raise_alerts(attempt.read("risk_assessments"), settings.alert_policy, settings.stamp), "alerts")

    def _new_findings(self, events: DataFrame, attempt: Attempt) -> DataFrame:
        """Findings that are not stored yet, numbered in order of arrival.

        Until the copies and the stored ones are gone, the order is a struct that is
        compared; only what is left is numbered.
        """
        if "arrival_seq" in events.columns:
            found = first_arrivals(finding_keys(events, self.settings.detection_rules, self.settings.stamp))
        else:
            placed = events.withColumn("arrival_seq", nz.arrival_order(events))
            found = first_arrivals(finding_keys(placed, self.settings.detection_rules, self.settings.stamp))
        found = attempt.stage(found, "findings")
        if attempt.batch_id > 0:
            first, last = found.agg(F.min("event_time"), F.max("event_time")).head()
            stored = self._within(self.store.read("detection_findings", before=attempt.batch_id), first, last)
            # The staged files have a known size: small ones are broadcast, and then only the
            # stored keys that the batch can meet go on to the anti join.
            met = stored.select(*FINDING_KEY).join(found.select(*FINDING_KEY), FINDING_KEY, "left_semi")
            found = found.join(met, FINDING_KEY, "left_anti")
        if "arrival_seq" in events.columns:
            return found
        return nz.with_arrival_numbers(found, attempt.batch_id * ARRIVALS_PER_BATCH)

    def _within(self, stored: DataFrame, first: datetime | None, last: datetime | None) -> DataFrame:
        """Stored rows that may repeat one of the batch: all, or those of its days and ``history_days`` before."""
        if self.history_days is None:
            return stored
        if first is None:
            return stored.limit(0)
        oldest = F.date_sub(F.to_date(F.lit(first)), self.history_days)
        return stored.filter(F.col("event_date").between(oldest, F.to_date(F.lit(last))))

    def _look_back(self, first: datetime | None, last: datetime | None, batch_id: int) -> DataFrame:
        """Stored findings any finding of the batch can look back on, pruned by day and time."""
        stored = self.store.read("detection_findings", before=batch_id)
        if first is None:
            return stored.limit(0)
        oldest = F.lit(first) - F.make_dt_interval(
            secs=F.lit(look_back_seconds(self.settings.correlation_rules))
        )
        return stored.filter(
            F.col("event_date").between(F.to_date(oldest), F.to_date(F.lit(last)))
            & F.col("event_time").between(oldest, F.lit(last))
        )

    def _run(self, status: str, inserted: int, bad: int, started: datetime, problem: str | None) -> DataFrame:
        finished = datetime.now(timezone.utc)
        return self.spark.createDataFrame([(self.hostname, status, inserted, bad, started, finished, problem)], COLLECTOR_RUNS)

    def advance(self, events: DataFrame, attempt: Attempt) -> None:
        """Write the checkpoints behind these events, for all hosts and channels."""
        processed = events if "source_host" in events.columns else self._with_host(events)
        attempt.write(advance_checkpoints(self.store.host_checkpoints(attempt.batch_id), processed), "checkpoints")

    def _store_metrics(self, snapshots: DataFrame, attempt: Attempt) -> None:
        time = None if self.batch_time is None else F.lit(self.batch_time)
        attempt.write(nz.to_host_metrics(snapshots, time), "host_metrics")

    def ingest_metrics(self, snapshots: DataFrame, batch_id: int) -> None:
        """Host metric snapshots alone; such batches are numbered apart from the events'."""
        attempt = self.store.attempt(batch_id)
        self._store_metrics(snapshots, attempt)
        attempt.commit("host_metrics")

    def start(self, documents: DataFrame, checkpoint: str, poll_seconds: int | None = 5) -> StreamingQuery:
        """Ingest a stream of documents; ``poll_seconds=None`` takes what is there and stops.

        ``checkpoint`` holds the progress of the stream, so a restart repeats at most
        the batch that was under way.
        """
        writer = documents.writeStream.foreachBatch(partial(_one_batch, self)).option(
            "checkpointLocation", checkpoint
        )
        if poll_seconds is None:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{poll_seconds} seconds").start()


def _document_hash():
    """Tells documents apart in the reject table; a missing text is a document of its own kind."""
    return F.sha2(F.to_json(F.struct("channel", "document")), 256)


def _one_batch(ingestion: Ingestion, documents: DataFrame, batch_id: int) -> None:
    ingestion.ingest(documents, batch_id)
