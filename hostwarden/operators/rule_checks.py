"""Rule sets, policies and query parameters as tables: the rows that the plan-time checks would refuse.

The checks of one installation's own rules happen in Python while a plan is built. These are
the same conditions over stored rules of any number, as those of many tenants or versions.
Every function returns the key of a row and a ``fault``, a row for each fault.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden import schemas
from hostwarden.operators.correlate import GROUP_FIELDS
from hostwarden.operators.detect import OPERATORS
from hostwarden.plans.lists import MAXIMUM_LIMIT


def _faults(rows: DataFrame, key: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    """A row per key and test that holds; one pass, no shuffle."""
    found = [F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]
    return rows.select(*key, F.explode(F.array_compact(F.array(*found))).alias("fault"))


def _given_twice(rules: DataFrame) -> DataFrame:
    """Rules whose id and version another rule has, too. Only identities that repeat meet the rules again."""
    identity = ["rule_id", "rule_version"]
    twice = rules.groupBy(*identity).agg(F.count("*").alias("rules")).filter("rules > 1")
    return rules.join(twice.select(*identity), identity, "left_semi").select("rule_no", F.lit("given_twice").alias("fault"))


def _blank(column: str) -> Column:
    return F.coalesce(F.length(F.trim(column)) == 0, F.lit(True))


def faulty_detection_rules(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """``rules``: rule_no, rule_id, rule_version, severity; ``conditions``: rule_no, operator."""
    known = F.coalesce(F.col("operator").isin(*OPERATORS), F.lit(False))
    held = conditions.groupBy("rule_no").agg(F.count_if(~known).alias("unknown"))
    tests = {
        "blank_id": _blank("rule_id"),
        "version_not_positive": F.col("rule_version") <= 0,
        "unknown_severity": ~F.col("severity").isin(*schemas.SEVERITIES),
        "no_conditions": F.col("unknown").isNull(),
        "unknown_operator": F.col("unknown") > 0,
    }
    return _faults(rules.join(held, "rule_no", "left"), ["rule_no"], tests).unionByName(_given_twice(rules))


def faulty_correlation_rules(rules: DataFrame) -> DataFrame:
    """``rules``: rule_no, rule_id, rule_version, severity, mode, required and group_by (arrays), window_seconds, minimum_matches."""
    distinct = F.size(F.array_distinct("required"))
    tests = {
        "blank_id": _blank("rule_id"),
        "version_not_positive": F.col("rule_version") <= 0,
        "unknown_severity": ~F.col("severity").isin(*schemas.SEVERITIES),
        "unknown_mode": ~F.col("mode").isin(*schemas.CORRELATION_MODES),
        "nothing_required": F.size("required") == 0,
        "no_group_fields": F.size("group_by") == 0,
        "unsupported_group_field": F.size(F.array_except("group_by", F.array(*[F.lit(f) for f in GROUP_FIELDS]))) > 0,
        "window_not_positive": F.col("window_seconds") <= 0,
        "minimum_not_positive": F.col("minimum_matches") <= 0,
        "minimum_below_required": (F.col("mode") == "same_event") & (F.col("minimum_matches") < distinct),
    }
    return _faults(rules, ["rule_no"], tests).unionByName(_given_twice(rules))


def faulty_contributions(contributions: DataFrame, providers: DataFrame) -> DataFrame:
    """``providers``: provider_no, name; ``contributions``: contribution_no, provider_no, provider -> subject, fault.

    A contribution must carry the name of the provider that gave it; names are given and unique.
    """
    repeated = providers.groupBy(F.trim("name").alias("_name")).agg(F.count("*").alias("_times"))
    named = providers.withColumn("_name", F.trim("name")).join(repeated, "_name", "left")
    subject = F.concat(F.lit("provider "), F.col("provider_no").cast("string")).alias("subject")
    own = _faults(named.withColumn("subject", subject), ["subject"], {"blank_name": _blank("name"), "name_twice": ~_blank("name") & (F.col("_times") > 1)})
    met = contributions.join(providers, "provider_no", "left")
    subject = F.concat(F.lit("contribution "), F.col("contribution_no").cast("string")).alias("subject")
    tests = {"unknown_provider": F.col("name").isNull(), "foreign_name": F.col("provider") != F.col("name")}
    return _faults(met.withColumn("subject", subject), ["subject"], tests).unionByName(own)


def faulty_risk_policies(policies: DataFrame) -> DataFrame:
    """``policies``: policy_no and the six bounds of a risk policy."""
    limits = [F.col(name) for name in ("informational_max", "low_max", "medium_max", "high_max")]
    rising = (limits[0] < limits[1]) & (limits[1] < limits[2]) & (limits[2] < limits[3])
    tests = {
        "bounds_out_of_order": F.col("minimum_score") >= F.col("maximum_score"),
        "limits_not_rising": ~rising,
        "limits_out_of_bounds": (limits[0] < F.col("minimum_score")) | (limits[3] >= F.col("maximum_score")),
    }
    return _faults(policies, ["policy_no"], tests)


def _whole(text: str) -> Column:
    """Whether a text is a whole number; a truth value is none."""
    return F.coalesce(F.col(text).rlike(r"^[+-]?[0-9]+$"), F.lit(False))


def faulty_alert_thresholds(thresholds: DataFrame) -> DataFrame:
    """``thresholds``: policy_no, minimum_score (text as it was given)."""
    number = F.col("minimum_score").try_cast("decimal(38,0)")
    tests = {"not_an_integer": ~_whole("minimum_score"), "out_of_range": _whole("minimum_score") & ~number.between(0, 100)}
    return _faults(thresholds, ["policy_no"], tests)


def faulty_parameters(requests: DataFrame) -> DataFrame:
    """``requests``: request_no, name, value (text; null where it was not given) -> request_no, fault.

    ``limit`` must be given; ``minimum_score``, ``severity``, ``risk_level`` and ``status`` need not be.
    """
    number, given = F.col("value").try_cast("decimal(38,0)"), F.col("value").isNotNull()
    domains = {"severity": schemas.SEVERITIES, "risk_level": schemas.RISK_LEVELS, "status": schemas.ALERT_STATUSES}
    tests = {
        "limit": (F.col("name") == "limit") & ~F.coalesce(_whole("value") & number.between(1, MAXIMUM_LIMIT), F.lit(False)),
        "minimum_score": (F.col("name") == "minimum_score") & given & ~F.coalesce(_whole("value") & number.between(0, 100), F.lit(False)),
        **{name: (F.col("name") == name) & ~F.col("value").isin(*domain) for name, domain in domains.items()},
        "unknown_name": ~F.col("name").isin("limit", "minimum_score", *domains),
    }
    return _faults(requests, ["request_no"], tests)
