"""The chain from normalized events to findings, matches, assessments and alerts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.operators.alerts import AlertPolicy, raise_alerts
from hostwarden.operators.anchored import anchored_groups
from hostwarden.operators.correlate import (
    CorrelationRule,
    insert_new_matches,
    match_rows,
    same_event_groups,
    validate_correlation_rules,
)
from hostwarden.operators.correlation_rules import BUILTIN_CORRELATION_RULES
from hostwarden.operators.detect import DetectionRule, finding_keys, with_rule_texts
from hostwarden.operators.detection_rules import BUILTIN_DETECTION_RULES
from hostwarden.operators.findings import insert_if_new
from hostwarden.operators.risk import BUILTIN_PROVIDERS, RiskPolicy, RiskProvider, assess
from hostwarden.operators.temporal import full_history_groups


@dataclass(frozen=True)
class Settings:
    """Rules, providers and policies of one installation."""

    detection_rules: Sequence[DetectionRule] = BUILTIN_DETECTION_RULES
    correlation_rules: Sequence[CorrelationRule] = BUILTIN_CORRELATION_RULES
    risk_policy: RiskPolicy = field(default_factory=RiskPolicy)
    risk_providers: Sequence[RiskProvider] = BUILTIN_PROVIDERS
    alert_policy: AlertPolicy = field(default_factory=AlertPolicy)
    stamp: Callable[[Column], Column] | None = None


def correlate_history(
    findings: DataFrame, rules: Sequence[CorrelationRule], stamp: Callable[[Column], Column] | None = None
) -> DataFrame:
    """All enabled rules over a complete set of findings, in rule order (``rule_pos``)."""
    validate_correlation_rules(rules)
    parts = []
    for pos, rule in enumerate(rules):
        if rule.enabled:
            mode = same_event_groups if rule.mode == "same_event" else full_history_groups
            parts.append(mode(findings, rule, pos))
    if not parts:
        return match_rows(anchored_groups(findings, ()), (), stamp)
    return match_rows(reduce(DataFrame.unionByName, parts), rules, stamp)


def correlate_new(
    findings: DataFrame,
    rules: Sequence[CorrelationRule],
    history: DataFrame | None = None,
    stored_matches: DataFrame | None = None,
    stamp: Callable[[Column], Column] | None = None,
    cells: int | None = None,
) -> DataFrame:
    """Matches that new findings complete, without those the table has already."""
    validate_correlation_rules(rules)
    groups = anchored_groups(findings, rules, history, cells)
    return insert_new_matches(match_rows(groups, rules, stamp), stored_matches)


@dataclass(frozen=True)
class Intelligence:
    """What one batch of events adds to each table."""

    findings: DataFrame
    matches: DataFrame
    assessments: DataFrame
    alerts: DataFrame
    alert_policy: AlertPolicy

    def counts(self) -> DataFrame:
        """Correlations, assessments and alerts created, as one row.

        Every match has one assessment and an alert is an assessment that reaches the
        threshold, so one pass over the assessments counts all three.
        """
        every = F.count("*")
        return self.assessments.agg(
            every.alias("correlations_created"),
            every.alias("assessments_created"),
            F.count_if(F.col("score") >= self.alert_policy.minimum_score).alias("alerts_created"),
        )


def new_findings(events: DataFrame, settings: Settings, stored: DataFrame | None = None) -> DataFrame:
    """Findings of a batch of events that are not stored yet, with their texts."""
    keys = finding_keys(events, settings.detection_rules, settings.stamp)
    return with_rule_texts(insert_if_new(keys, stored), settings.detection_rules)


def derive(
    findings: DataFrame,
    settings: Settings,
    history: DataFrame | None = None,
    stored_matches: DataFrame | None = None,
) -> Intelligence:
    """New findings -> new matches -> assessments -> alerts."""
    rules = settings.correlation_rules
    matches = correlate_new(findings, rules, history, stored_matches, settings.stamp)
    assessments = assess(matches, settings.risk_policy, settings.risk_providers, settings.stamp)
    alerts = raise_alerts(assessments, settings.alert_policy, settings.stamp)
    return Intelligence(findings, matches, assessments, alerts, settings.alert_policy)


def process(events: DataFrame, settings: Settings = Settings()) -> Intelligence:
    """The whole chain over one complete set of normalized events."""
    return derive(new_findings(events, settings), settings)
