"""Detection rules compiled to column predicates."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hostwarden.functions.text import fold, has_token, stable_uuid
from hostwarden.schemas import DETECTION_FINDINGS, SEVERITIES, columns_of


@dataclass(frozen=True)
class FieldCondition:
    """One comparison of an event field with given values."""

    field_path: str
    operator: str
    values: tuple[str, ...]
    case_sensitive: bool = False


@dataclass(frozen=True)
class DetectionRule:
    """A versioned rule for one source type and event id."""

    rule_id: str
    version: int
    name: str
    description: str
    severity: str
    source_type: str
    event_id: int
    conditions: tuple[FieldCondition, ...]
    explanation: str
    investigation_steps: tuple[str, ...] = ()
    enabled: bool = True
    tags: tuple[str, ...] = ()


def _any_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def _all_of(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def _has_token(text: Column, values: Sequence[str]) -> Column:
    # A token is a substring, so most rows are settled without the regular expression.
    return _any_of([text.contains(v) for v in values]) & has_token(text, tuple(values))


OPERATORS: dict[str, Callable[[Column, Sequence[str]], Column]] = {
    "equals": lambda text, values: text.isin(*values) if values else F.lit(False),
    "contains": lambda text, values: _all_of([text.contains(v) for v in values]),
    "contains_any": lambda text, values: _any_of([text.contains(v) for v in values]),
    "contains_any_token": _has_token,
    "ends_with": lambda text, values: _all_of([text.endswith(v) for v in values]),
    "ends_with_any": lambda text, values: _any_of([text.endswith(v) for v in values]),
}


def validate_rules(rules: Sequence[DetectionRule]) -> None:
    """Refuse a rule set that cannot be evaluated, before any job starts."""
    identities = [(rule.rule_id, rule.version) for rule in rules]
    for rule in rules:
        label = f"detection rule {rule.rule_id!r} version {rule.version}"
        if identities.count((rule.rule_id, rule.version)) > 1:
            raise ValueError(f"{label} is given twice")
        if not rule.rule_id.strip():
            raise ValueError("a detection rule has a blank id")
        if rule.version <= 0:
            raise ValueError(f"{label}: the version must be positive")
        if rule.severity not in SEVERITIES:
            raise ValueError(f"{label}: unknown severity {rule.severity!r}")
        if not rule.conditions:
            raise ValueError(f"{label} has no conditions")
        for condition in rule.conditions:
            if condition.operator not in OPERATORS:
                raise ValueError(f"{label}: unknown operator {condition.operator!r}")


def field_text(schema: T.StructType, path: str) -> Column:
    """The value at a dotted path as text; null where a segment is missing.

    The path walks through structs, then map keys, then VARIANT objects.
    """
    missing = F.lit(None).cast("string")
    column, kind = None, schema
    segments = path.split(".")
    for depth, segment in enumerate(segments):
        if isinstance(kind, T.StructType):
            if segment not in kind.fieldNames():
                return missing
            column = F.col(f"`{segment}`") if column is None else column.getField(segment)
            kind = kind[segment].dataType
        elif isinstance(kind, T.MapType):
            column, kind = column[segment], kind.valueType
        elif isinstance(kind, T.VariantType):
            keys = "".join(f'["{key}"]' for key in segments[depth:])
            return F.try_variant_get(column, f"${keys}", "string")
        else:
            return missing
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(column, "$", "string")
    if isinstance(kind, T.BooleanType):
        return F.initcap(column.cast("string"))
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(column)
    return column.cast("string")


def condition_matches(text: Column, condition: FieldCondition) -> Column:
    """True or false, never null: a missing value matches nothing.

    ``text`` is the field's value, case-folded already unless the condition is
    case-sensitive; the expected values are folded here, once per plan.
    """
    values = condition.values
    if not condition.case_sensitive:
        values = tuple(value.casefold() for value in values)
    return F.coalesce(text.isNotNull() & OPERATORS[condition.operator](text, values), F.lit(False))


def is_eligible(rule: DetectionRule) -> Column:
    """Rule switched on, same source type, same whole-number event id (missing counts as 0)."""
    number = F.coalesce(F.col("event_id").try_cast("bigint"), F.when(F.col("event_id").isNull(), 0))
    same = (F.col("source_type") == rule.source_type) & (number == rule.event_id)
    return F.coalesce(same, F.lit(False)) if rule.enabled else F.lit(False)


def _index(events: DataFrame, rules: Sequence[DetectionRule]) -> DataFrame:
    """Rows that some rule's source and event id can meet, by plain comparisons that a Parquet scan takes over.

    They need a whole-number column; of another type every row goes on to the exact test.
    """
    kinds = {field.name: field.dataType for field in events.schema.fields}
    if not rules:
        return events.filter(F.lit(False))
    if not isinstance(kinds["event_id"], (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return events
    numbers = sorted({rule.event_id for rule in rules})
    number = F.col("event_id").isin(*numbers)
    if 0 in numbers:
        number |= F.col("event_id").isNull()
    return events.filter(F.col("source_type").isin(*sorted({rule.source_type for rule in rules})) & number)


def _dispatched(active: Sequence[tuple[int, DetectionRule]], hits: dict[int, Column], eligible: dict[int, Column], kind: str) -> Column:
    """The hits of a row. Rules of one source and event id are tested together, so a row runs into those of its own pair only."""
    pairs: dict[tuple[str, int], list[int]] = {}
    for pos, rule in active:
        pairs.setdefault((rule.source_type, rule.event_id), []).append(pos)
    chosen = F.lit(None).cast(f"array<{kind}>")
    for places in pairs.values():
        chosen = F.when(eligible[places[0]], F.array(*[hits[pos] for pos in places])).otherwise(chosen)
    return chosen


def rule_matches(events: DataFrame, rules: Sequence[DetectionRule]) -> DataFrame:
    """One row per event and matching rule: the event's columns, ``rule_pos``, ``evidence``.

    All rules run in one pass over the events. Rows of no rule's source and event
    id are filtered first, where the scan takes the predicate over, and the rest
    never leaves the stage: no shuffle.
    """
    validate_rules(rules)
    active = [(pos, rule) for pos, rule in enumerate(rules) if rule.enabled]
    eligible = {pos: is_eligible(rule) for pos, rule in active}
    # Every field is read, and folded, once per row however many conditions use it.
    texts: dict[tuple[str, bool], str] = {}
    for _, rule in active:
        for condition in rule.conditions:
            texts.setdefault((condition.field_path, False), f"_text{len(texts)}")
            if not condition.case_sensitive:
                texts.setdefault((condition.field_path, True), f"_text{len(texts)}")
    plain = {name: field_text(events.schema, path) for (path, folded), name in texts.items() if not folded}
    folds = {name: fold(F.col(texts[path, False])) for (path, folded), name in texts.items() if folded}
    kind = "struct<rule_pos: int, evidence: map<string, string>>"
    hits = {}
    for pos, rule in active:
        found = _all_of(
            [condition_matches(F.col(texts[c.field_path, not c.case_sensitive]), c) for c in rule.conditions]
        )
        paths = dict.fromkeys(c.field_path for c in rule.conditions)
        evidence = F.create_map(
            *[part for p in paths for part in (F.lit(p), F.col(texts[p, False]))]
        )
        hit = F.struct(F.lit(pos).alias("rule_pos"), evidence.alias("evidence"))
        hits[pos] = F.when(found, hit)
    return (
        _index(events, [rule for _, rule in active])
        .withColumns(plain)
        .withColumns(folds)
        .withColumn("_hit", F.explode(_dispatched(active, hits, eligible, kind)))
        .filter(F.col("_hit").isNotNull())
        .select(*events.columns, "_hit.rule_pos", "_hit.evidence")
    )


def _of_rule(rules: Sequence, value: Callable, kind: str) -> Column:
    """A per-rule constant looked up by ``rule_pos``.

    All constants are one JSON literal that the optimizer folds, so a large rule
    set does not blow up the plan.
    """
    constants = json.dumps([value(rule) for rule in rules], ensure_ascii=False)
    return F.get(F.from_json(F.lit(constants), f"array<{kind}>"), F.col("rule_pos"))


def finding_keys(
    events: DataFrame, rules: Sequence[DetectionRule], stamp: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Findings without the constant texts of their rules, narrow enough to shuffle."""
    matched = rule_matches(events, rules)
    time = F.col("time_created")
    now = F.current_timestamp() if stamp is None else stamp(time)
    keyed = matched.select(
        "rule_pos",
        _of_rule(rules, lambda r: r.rule_id, "string").alias("rule_id"),
        _of_rule(rules, lambda r: r.version, "int").alias("rule_version"),
        F.coalesce("computer", F.lit("")).alias("source_host"),
        F.coalesce("source_type", F.lit("")).alias("source_type"),
        F.coalesce(F.col("event_id").try_cast("bigint"), F.lit(0)).alias("event_id"),
        F.col("record_id").try_cast("bigint").alias("event_record_id"),
        F.coalesce(time, now).alias("event_time"),
        now.alias("evaluated_at"),
        "evidence",
        "arrival_seq",
    )
    return keyed.withColumn("finding_uuid", stable_uuid("finding", _natural_key()))


def _natural_key() -> Column:
    """Text of the uniqueness key; without record id every arrival is its own finding."""
    record = F.coalesce(
        F.col("event_record_id").cast("string"),
        F.concat(F.lit("None|"), F.col("arrival_seq").cast("string")),
    )
    return F.concat_ws(
        "|", "rule_id", F.col("rule_version").cast("string"), "source_host", "source_type",
        F.col("event_id").cast("string"), record,
    )


def with_rule_texts(keys: DataFrame, rules: Sequence[DetectionRule]) -> DataFrame:
    """Full finding rows. The texts are added last so that no shuffle carries them."""
    texts = keys.select(
        "*",
        _of_rule(rules, lambda r: r.name, "string").alias("title"),
        _of_rule(rules, lambda r: r.severity, "string").alias("severity"),
        _of_rule(rules, lambda r: r.explanation, "string").alias("explanation"),
        _of_rule(rules, lambda r: r.investigation_steps, "array<string>").alias("investigation_steps"),
        _of_rule(rules, lambda r: r.tags, "array<string>").alias("tags"),
        F.col("evaluated_at").alias("created_at"),
    )
    return texts.select(*columns_of(DETECTION_FINDINGS))


def detect(
    events: DataFrame, rules: Sequence[DetectionRule], stamp: Callable[[Column], Column] | None = None
) -> DataFrame:
    """All findings of all rules. ``stamp`` gives the processing time of an event time."""
    return with_rule_texts(finding_keys(events, rules, stamp), rules)
