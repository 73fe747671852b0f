"""Correlation rules, their checks, and the parts all correlation modes share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.functions.text import json_list, json_string, stable_uuid
from hostwarden.operators.detect import _of_rule
from hostwarden.schemas import CORRELATION_MATCHES, CORRELATION_MODES, SEVERITIES, columns_of

# The finding fields a rule may group by.
GROUP_FIELDS = ("source_host", "source_type", "event_id", "event_record_id", "rule_id", "rule_version")
_TEXT_FIELDS = ("source_host", "source_type", "rule_id")

# What correlation needs to know of a finding; everything else stays behind.
REF_FIELDS = ("finding_uuid", "event_time", "arrival_seq", *GROUP_FIELDS)
REF_TYPE = (
    "struct<finding_uuid: string, event_time: timestamp, arrival_seq: bigint, source_host: string,"
    " source_type: string, event_id: bigint, event_record_id: bigint, rule_id: string, rule_version: int>"
)


@dataclass(frozen=True)
class CorrelationRule:
    """A versioned rule over findings."""

    rule_id: str
    version: int
    name: str
    description: str
    severity: str
    mode: str
    required_detection_rule_ids: tuple[str, ...]
    group_by: tuple[str, ...]
    window_seconds: int
    minimum_matches: int
    explanation: str
    investigation_steps: tuple[str, ...] = ()
    enabled: bool = True
    tags: tuple[str, ...] = ()


def validate_correlation_rules(rules: Sequence[CorrelationRule]) -> None:
    """Refuse a rule set that cannot be evaluated, before any job starts."""
    identities = [(rule.rule_id, rule.version) for rule in rules]
    for rule in rules:
        required = rule.required_detection_rule_ids
        unknown = sorted(set(rule.group_by) - set(GROUP_FIELDS))
        checks = {
            "is given twice": identities.count((rule.rule_id, rule.version)) > 1,
            "has a blank id": not rule.rule_id.strip(),
            "must have a positive version": rule.version <= 0,
            f"has the unknown severity {rule.severity!r}": rule.severity not in SEVERITIES,
            f"has the unknown mode {rule.mode!r}": rule.mode not in CORRELATION_MODES,
            "requires no detection rules": not required,
            "has no grouping fields": not rule.group_by,
            f"groups by unsupported fields {unknown}": bool(unknown),
            "must have a positive window": rule.window_seconds <= 0,
            "must require at least one match": rule.minimum_matches <= 0,
            "requires fewer matches than distinct detection rules": rule.mode == "same_event"
            and rule.minimum_matches < len(set(required)),
        }
        for problem, found in checks.items():
            if found:
                raise ValueError(f"correlation rule {rule.rule_id!r} version {rule.version} {problem}")


def required_rule_ids(rules: Sequence[CorrelationRule]) -> list[str]:
    """Detection rules any correlation rule needs; disabled ones count too."""
    return sorted({rule_id for rule in rules for rule_id in rule.required_detection_rule_ids})


def look_back_seconds(rules: Sequence[CorrelationRule]) -> int:
    """Longest window of all rules; disabled ones count too."""
    return max((rule.window_seconds for rule in rules), default=0)


def refs(findings: DataFrame) -> DataFrame:
    """The columns correlation works on."""
    return findings.select(*REF_FIELDS)


def of_rules(findings: DataFrame, rule_ids: Sequence[str], group_by: Sequence[str]) -> DataFrame:
    """Findings of some detection rules that have a value in every grouping field."""
    return findings.filter(F.col("rule_id").isin(*rule_ids)).na.drop(subset=list(group_by))


def without_copies(findings: DataFrame) -> DataFrame:
    """One finding per host, source, event, record (or own id) and rule, the earliest.

    A partial aggregate: a finding that was copied a billion times shrinks to one
    row per input partition before the shuffle.
    """
    identity = F.coalesce(F.col("event_record_id").cast("string"), F.col("finding_uuid"))
    key = ["source_host", "source_type", "event_id", "rule_id", "rule_version"]
    return (
        findings.groupBy(*key, identity.alias("_identity"))
        .agg(
            F.min_by(F.struct(*findings.columns), F.struct("event_time", "arrival_seq", "finding_uuid"))
            .alias("_row")
        )
        .select("_row.*")
    )


def event_key(ref: Column) -> Column:
    """``host|source|event|record|rule|version``; a missing record id is the text None."""
    return F.concat_ws(
        "|",
        ref["source_host"],
        ref["source_type"],
        ref["event_id"].cast("string"),
        F.coalesce(ref["event_record_id"].cast("string"), F.lit("None")),
        ref["rule_id"],
        ref["rule_version"].cast("string"),
    )


def _group_key_json(rule: CorrelationRule, first: Column) -> Column:
    return json_list(
        *[
            json_string(first[field]) if field in _TEXT_FIELDS else first[field].cast("string")
            for field in rule.group_by
        ]
    )


def _evidence_json(rules: Sequence[CorrelationRule]) -> Column:
    """Match evidence as JSON text with sorted keys."""
    first, count = F.col("members")[0], F.size("members").cast("string")
    chosen = F.lit(None).cast("string")
    for pos, rule in enumerate(rules):
        parts = [F.lit('{"finding_count":'), count, F.lit(',"group_key":'), _group_key_json(rule, first)]
        if rule.mode == "temporal_count":
            parts.append(F.lit(f',"window_seconds":{rule.window_seconds}'))
        chosen = F.when(F.col("rule_pos") == pos, F.concat(*parts, F.lit("}"))).otherwise(chosen)
    return chosen


def correlation_key(rule_id: Column, version: Column, host: Column, event_keys: Column) -> Column:
    """Stable fingerprint of a match."""
    return F.sha2(
        F.concat_ws("|", rule_id, version.cast("string"), host, F.array_join(event_keys, "|")), 256
    )


def match_rows(
    groups: DataFrame,
    rules: Sequence[CorrelationRule],
    stamp: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(rule_pos, members)`` -> match rows.

    ``members`` are finding refs ordered by event time. ``arrival_seq`` of the
    result is the arrival that completed the match.
    """
    members = F.col("members")
    keyed = groups.select(
        "rule_pos",
        "members",
        _of_rule(rules, lambda r: r.rule_id, "string").alias("rule_id"),
        _of_rule(rules, lambda r: r.version, "int").alias("rule_version"),
        members[0]["source_host"].alias("source_host"),
        members[0]["event_time"].alias("first_event_time"),
        F.element_at("members", -1)["event_time"].alias("last_event_time"),
        F.array_sort(F.transform(members, event_key)).alias("_event_keys"),
        F.array_max(F.transform(members, lambda m: m["arrival_seq"])).alias("arrival_seq"),
        _evidence_json(rules).alias("evidence"),
    ).withColumn(
        "correlation_key",
        correlation_key(
            F.col("rule_id"), F.col("rule_version"), F.col("source_host"), F.col("_event_keys")
        ),
    )
    time = F.col("last_event_time")
    texts = keyed.select(
        "*",
        stable_uuid("correlation", F.col("correlation_key")).alias("correlation_uuid"),
        F.transform(members, lambda m: m["finding_uuid"]).alias("matched_finding_ids"),
        F.transform(members, lambda m: m["rule_id"]).alias("matched_detection_rule_ids"),
        _of_rule(rules, lambda r: r.name, "string").alias("title"),
        _of_rule(rules, lambda r: r.severity, "string").alias("severity"),
        _of_rule(rules, lambda r: r.explanation, "string").alias("explanation"),
        _of_rule(rules, lambda r: r.investigation_steps, "array<string>").alias("investigation_steps"),
        _of_rule(rules, lambda r: r.tags, "array<string>").alias("tags"),
        (F.current_timestamp() if stamp is None else stamp(time)).alias("created_at"),
    )
    return texts.select(*columns_of(CORRELATION_MATCHES), "arrival_seq", "rule_pos")


def insert_new_matches(matches: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One match per correlation key, the first to arrive, and none the table has already."""
    row = F.struct(*matches.columns)
    fresh = (
        matches.groupBy("correlation_key")
        .agg(F.min_by(row, F.struct("arrival_seq", "last_event_time", "matched_finding_ids")).alias("_row"))
        .select("_row.*")
    )
    if stored is None:
        return fresh
    return fresh.join(stored.select("correlation_key"), "correlation_key", "left_anti")


def same_event_groups(findings: DataFrame, rule: CorrelationRule, rule_pos: int) -> DataFrame:
    """Same-event mode over the full history -> ``(rule_pos, members)``.

    Per group the first finding of every required rule, by a partial aggregate
    per required rule: a group keeps one row per rule however large it is. The
    group passes when all rules are present, enough findings are selected and
    they lie within the window.
    """
    ids = rule.required_detection_rule_ids
    eligible = of_rules(refs(findings), ids, rule.group_by)
    ref, place = F.struct(*REF_FIELDS), F.struct("event_time", "arrival_seq", "finding_uuid")
    firsts = [
        F.min_by(F.when(F.col("rule_id") == q, ref), F.when(F.col("rule_id") == q, place)).alias(f"_f{i}")
        for i, q in enumerate(dict.fromkeys(ids))
    ]
    names = {q: f"_f{i}" for i, q in enumerate(dict.fromkeys(ids))}
    grouped = eligible.groupBy(*[F.col(field).alias(f"_g{i}") for i, field in enumerate(rule.group_by)])
    complete = reduce(Column.__and__, [F.col(name).isNotNull() for name in names.values()])
    times = [F.col(names[q])["event_time"] for q in ids]
    span = F.unix_micros(_greatest(times)) - F.unix_micros(_least(times))
    selected = F.array(*[F.col(names[q]) for q in ids])
    return (
        grouped.agg(*firsts)
        .filter(complete & F.lit(len(ids) >= rule.minimum_matches))
        .filter(span <= rule.window_seconds * 1_000_000)
        .select(F.lit(rule_pos).alias("rule_pos"), by_event_time(selected).alias("members"))
    )


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def by_event_time(members: Column) -> Column:
    """Members ordered by event time; equal times keep their given order."""
    placed = F.transform(
        members, lambda m, i: F.struct(m["event_time"].alias("t"), i.alias("i"), m.alias("m"))
    )
    return F.transform(F.array_sort(placed), lambda p: p["m"])
