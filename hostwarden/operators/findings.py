"""Finding storage operators: insert-if-new, look-back read, typed read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

FINDING_KEY = ["rule_id", "rule_version", "source_host", "source_type", "event_id", "event_record_id"]


def first_arrivals(findings: DataFrame) -> DataFrame:
    """One finding per uniqueness key, the one that arrived first.

    Rows without record id have no key and all stay: each gets its own group
    through its id and arrival. ``min_by`` is a partial aggregate, so copies of
    one finding collapse before the shuffle however many there are.
    """
    keyless = F.col("event_record_id").isNull()
    own_id = F.when(keyless, F.col("finding_uuid"))
    own_arrival = F.when(keyless, F.col("arrival_seq"))
    row = F.struct(*findings.columns)
    return (
        findings.groupBy(*FINDING_KEY, own_id.alias("_id"), own_arrival.alias("_seq"))
        .agg(F.min_by(row, F.struct("arrival_seq", "event_time", "finding_uuid")).alias("_row"))
        .select("_row.*")
    )


def insert_if_new(findings: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The findings of a batch that the table does not have yet.

    ``stored`` only needs the key columns. Rows with a null record id never meet
    the anti join, because null equals nothing.
    """
    fresh = first_arrivals(findings)
    if stored is None:
        return fresh
    return fresh.join(stored.select(*FINDING_KEY), FINDING_KEY, "left_anti")


def recent_findings(
    findings: DataFrame, source_host: str, rule_ids: Sequence[str], start: Column, end: Column
) -> DataFrame:
    """Findings of a host and some rules in a closed time range, oldest first."""
    return findings.filter(
        (F.col("source_host") == source_host)
        & (F.col("rule_id").isin(*rule_ids) if rule_ids else F.lit(False))
        & F.col("event_time").between(start, end)
    ).orderBy("event_time", "finding_uuid")


def findings_from_text(rows: DataFrame) -> DataFrame:
    """Findings whose steps and evidence are JSON text -> typed arrays and maps; null is empty."""
    return rows.withColumns(
        {
            "investigation_steps": F.coalesce(
                F.from_json("investigation_steps", "ARRAY<STRING>"),
                F.expr("CAST(array() AS ARRAY<STRING>)"),
            ),
            "evidence": F.coalesce(
                F.from_json("evidence", "MAP<STRING, STRING>"),
                F.expr("CAST(map() AS MAP<STRING, STRING>)"),
            ),
            "tags": F.coalesce("tags", F.expr("CAST(array() AS ARRAY<STRING>)")),
        }
    )


def findings_to_text(findings: DataFrame) -> DataFrame:
    """The JSON-text form of steps and evidence."""
    return findings.withColumns(
        {"investigation_steps": F.to_json("investigation_steps"), "evidence": F.to_json("evidence")}
    )
