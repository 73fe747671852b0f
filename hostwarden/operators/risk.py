"""Risk scoring of correlation matches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.functions.text import stable_uuid
from hostwarden.schemas import RISK_ASSESSMENTS, columns_of

CONTRIBUTION = "struct<provider: string, reason: string, score_delta: int, evidence: string>"

# Base score of each severity.
BASE_SCORES = {"informational": 10, "low": 25, "medium": 40, "high": 65, "critical": 85}


@dataclass(frozen=True)
class RiskPolicy:
    """Score bounds and the highest score of each level below critical."""

    minimum_score: int = 0
    maximum_score: int = 100
    informational_max: int = 19
    low_max: int = 39
    medium_max: int = 59
    high_max: int = 79

    def __post_init__(self) -> None:
        limits = self.limits
        if self.minimum_score >= self.maximum_score:
            raise ValueError("the minimum score must be below the maximum score")
        if any(low >= high for low, high in zip(limits, limits[1:])):
            raise ValueError("the level limits must rise strictly")
        if limits[0] < self.minimum_score or limits[-1] >= self.maximum_score:
            raise ValueError("the level limits must lie within the score bounds")

    @property
    def limits(self) -> tuple[int, ...]:
        return self.informational_max, self.low_max, self.medium_max, self.high_max

    def clamp(self, score: Column) -> Column:
        return F.greatest(F.lit(self.minimum_score), F.least(score, F.lit(self.maximum_score)))

    def level_of(self, score: Column) -> Column:
        bounded = self.clamp(score)
        return (
            F.when(bounded <= self.informational_max, "informational")
            .when(bounded <= self.low_max, "low")
            .when(bounded <= self.medium_max, "medium")
            .when(bounded <= self.high_max, "high")
            .otherwise("critical")
        )

    def base_score(self, severity: Column) -> Column:
        scores = F.create_map(*[F.lit(part) for pair in BASE_SCORES.items() for part in pair])
        return scores[severity]


@dataclass(frozen=True)
class RiskProvider:
    """A named source of score contributions.

    ``contributions`` builds, over the columns of the match, an array of
    ``contribution(...)`` structs; null or an empty array adds nothing.
    """

    name: str
    contributions: Callable[[], Column]


def contribution(provider: str, reason: str | Column, score_delta: int | Column, evidence: Column | None = None) -> Column:
    """One explainable score adjustment; ``evidence`` is a struct shown as JSON."""
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    return F.struct(
        F.lit(provider).alias("provider"),
        as_column(reason).alias("reason"),
        as_column(score_delta).cast("int").alias("score_delta"),
        (F.lit("{}") if evidence is None else F.to_json(evidence)).alias("evidence"),
    )


def _repeated_activity() -> Column:
    evidence = F.struct(
        F.col("rule_id").alias("correlation_rule_id"), F.size("matched_finding_ids").alias("finding_count")
    )
    # Text and delta of the built-in provider.
    reason = "Repeated encoded PowerShell activity occurred within the correlation window."
    return F.when(
        F.col("rule_id") == "TP-CORR-WIN-0002",
        F.array(contribution("repeated_activity", reason, 15, evidence)),
    )


REPEATED_ACTIVITY = RiskProvider("repeated_activity", _repeated_activity)
BUILTIN_PROVIDERS = (REPEATED_ACTIVITY,)


def validate_providers(providers: Sequence[RiskProvider]) -> None:
    """Names must be given and unique."""
    names = [provider.name.strip() for provider in providers]
    if not all(names):
        raise ValueError("a risk provider has a blank name")
    if len(set(names)) < len(names):
        raise ValueError(f"risk provider names repeat: {sorted(names)}")


def _checked(provider: RiskProvider) -> Column:
    """The provider's contributions, refused when one carries another name."""
    none = F.array().cast(f"array<{CONTRIBUTION}>")
    given = F.coalesce(provider.contributions().cast(f"array<{CONTRIBUTION}>"), none)
    foreign = F.exists(given, lambda c: c["provider"] != provider.name)
    message = F.lit(f"risk contribution under a name other than {provider.name!r}")
    return F.when(foreign, F.raise_error(message).cast(f"array<{CONTRIBUTION}>")).otherwise(given)


def assess(
    matches: DataFrame,
    policy: RiskPolicy = RiskPolicy(),
    providers: Sequence[RiskProvider] = BUILTIN_PROVIDERS,
    stamp: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One assessment per match. A projection: no shuffle, no Python."""
    validate_providers(providers)
    lists = [_checked(provider) for provider in providers]
    none = F.array().cast(f"array<{CONTRIBUTION}>")
    scored = matches.withColumn(
        "contributions", F.flatten(F.array(*lists)) if lists else none
    ).withColumn("base_score", policy.base_score(F.col("severity")))
    total = F.aggregate(
        "contributions", F.col("base_score"), lambda acc, c: acc + c["score_delta"]
    )
    scored = scored.withColumn("score", policy.clamp(total)).withColumn(
        "level", policy.level_of(F.col("score"))
    )
    now = F.current_timestamp() if stamp is None else stamp(F.col("last_event_time"))
    explanation = F.format_string(
        "Risk score %d (%s) derived from base score %d and %d contribution(s).",
        "score", "level", "base_score", F.size("contributions"),
    )
    evidence = F.struct(
        F.col("severity").alias("correlation_severity"),
        F.col("title").alias("correlation_title"),
        F.col("matched_finding_ids").alias("matched_finding_ids"),
    )
    columns = {
        "assessment_uuid": stable_uuid("assessment", F.col("correlation_uuid")),
        "correlation_rule_id": F.col("rule_id"),
        "assessed_at": now,
        "explanation": explanation,
        "evidence": evidence,
        "created_at": now,
    }
    return scored.select(
        *[columns[name].alias(name) if name in columns else F.col(name) for name in columns_of(RISK_ASSESSMENTS)]
    )
