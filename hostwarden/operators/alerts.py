"""Alerts from risk assessments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.functions.text import stable_uuid
from hostwarden.schemas import ALERTS, columns_of


@dataclass(frozen=True)
class AlertPolicy:
    """Score from which an assessment becomes an alert."""

    minimum_score: int = 40

    def __post_init__(self) -> None:
        if isinstance(self.minimum_score, bool) or not isinstance(self.minimum_score, int):
            raise TypeError("the alert threshold must be an integer")
        if not 0 <= self.minimum_score <= 100:
            raise ValueError("the alert threshold must lie between 0 and 100")


def title_of(level: Column, host: Column) -> Column:
    return F.concat(F.initcap(level), F.lit(" Risk Activity on "), host)


def summary_of(assessment_uuid: Column, score: Column, level: Column) -> Column:
    return F.format_string(
        "Risk assessment %s produced score %d/100 (%s).", assessment_uuid, score, level
    )


def raise_alerts(
    assessments: DataFrame,
    policy: AlertPolicy = AlertPolicy(),
    stamp: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """New alerts of the assessments that reach the threshold."""
    now = F.current_timestamp() if stamp is None else stamp(F.col("last_event_time"))
    columns = {
        "alert_uuid": stable_uuid("alert", F.col("assessment_uuid")),
        "title": title_of(F.col("level"), F.col("source_host")),
        "risk_score": F.col("score"),
        "risk_level": F.col("level"),
        "status": F.lit("new"),
        "created_at": now,
        "summary": summary_of(F.col("assessment_uuid"), F.col("score"), F.col("level")),
        "evidence": F.struct(
            F.col("base_score"),
            F.size("contributions").alias("contribution_count"),
            F.col("evidence").alias("risk_evidence"),
        ),
        "inserted_at": now,
    }
    return assessments.filter(F.col("score") >= policy.minimum_score).select(
        *[columns[name].alias(name) if name in columns else F.col(name) for name in columns_of(ALERTS)]
    )
