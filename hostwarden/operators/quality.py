"""Row checks on stored tables: split into accepted and rejected rows, or refuse the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from hostwarden import schemas


@dataclass(frozen=True)
class Check:
    """A named row condition. As in SQL, a null outcome does not violate it."""

    name: str
    passes: Column


def severity_domain(column: str = "severity") -> Check:
    return Check("severity_domain", F.col(column).isin(*schemas.SEVERITIES))


def level_domain(column: str) -> Check:
    return Check("level_domain", F.col(column).isin(*schemas.RISK_LEVELS))


def status_domain(column: str = "status") -> Check:
    return Check("status_domain", F.col(column).isin(*schemas.ALERT_STATUSES))


def positive_version(column: str = "rule_version") -> Check:
    return Check("rule_version_positive", F.col(column) > 0)


def score_range(column: str) -> Check:
    return Check(f"{column}_range", F.col(column).between(0, 100))


def required(*columns: str) -> list[Check]:
    return [Check(f"{column}_required", F.col(column).isNotNull()) for column in columns]


_NULLABLE = {
    "detection_findings": ("event_record_id", "arrival_seq"),
    "correlation_matches": ("correlation_key",),
    "risk_assessments": (),
    "alerts": (),
}


def table_checks(table: str) -> list[Check]:
    """The checks of a stored table."""
    needed = [c for c in schemas.columns_of(schemas.TABLES[table]) if c not in _NULLABLE[table]]
    by_table = {
        "detection_findings": lambda: [severity_domain(), positive_version()],
        "correlation_matches": lambda: [severity_domain(), positive_version()],
        "risk_assessments": lambda: [score_range("score"), score_range("base_score"), level_domain("level")],
        "alerts": lambda: [score_range("risk_score"), level_domain("risk_level"), status_domain()],
    }
    return by_table[table]() + required(*needed)


def violations(checks: Sequence[Check]) -> Column:
    """Names of the checks a row fails."""
    failed = [F.when(~F.coalesce(check.passes, F.lit(True)), check.name) for check in checks]
    return F.array_compact(F.array(*failed))


def marked(rows: DataFrame, checks: Sequence[Check]) -> DataFrame:
    return rows.withColumn("violations", violations(checks))


def accepted_rows(rows: DataFrame, checks: Sequence[Check], strict: bool = False) -> DataFrame:
    """Rows that pass every check; ``strict`` fails the job at the first other one."""
    named = violations(checks)
    if strict:
        message = F.concat(F.lit("row violates "), F.array_join(named, ", "))
        return rows.filter(F.when(F.size(named) == 0, True).otherwise(F.raise_error(message).cast("boolean")))
    return rows.filter(F.size(named) == 0)


def rejected_rows(rows: DataFrame, checks: Sequence[Check]) -> DataFrame:
    return marked(rows, checks).filter(F.size("violations") > 0)


def repeated_ids(rows: DataFrame, column: str) -> DataFrame:
    """Ids that occur more than once, with their counts."""
    return rows.groupBy(column).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def unique_by(rows: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """One row per id, the first in ``order``; copies collapse before the shuffle."""
    return (
        rows.groupBy(column)
        .agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def repeated_keys(rows: DataFrame, key: Sequence[str], present: str) -> DataFrame:
    """Key values that occur more than once among rows whose ``present`` column is not null."""
    counted = rows.filter(F.col(present).isNotNull()).groupBy(*key)
    return counted.agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def read_contract(rows: DataFrame, table: str) -> DataFrame:
    """The table with the promised columns and types, failing on a row outside the domains."""
    wanted = StructType.fromDDL(schemas.TABLES[table])
    actual = {field.name: field.dataType.simpleString() for field in rows.schema}
    for field in wanted:
        if actual.get(field.name) != field.dataType.simpleString():
            raise ValueError(f"{table}.{field.name} is {actual.get(field.name)}, not {field.dataType.simpleString()}")
    return accepted_rows(rows.select(*wanted.fieldNames()), table_checks(table), strict=True)
