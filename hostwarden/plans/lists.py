"""Building blocks of the list queries: optional filters, parameter checks, top-k, counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MAXIMUM_LIMIT = 500


def check_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAXIMUM_LIMIT:
        raise ValueError(f"the limit must be a whole number from 1 to {MAXIMUM_LIMIT}, not {limit!r}")
    return limit


def check_minimum_score(score: int | None) -> int | None:
    if score is not None and (isinstance(score, bool) or not isinstance(score, int) or not 0 <= score <= 100):
        raise ValueError(f"the minimum score must be a whole number from 0 to 100, not {score!r}")
    return score


def check_choice(name: str, value: str | None, domain: Sequence[str]) -> str | None:
    if value is not None and value not in domain:
        raise ValueError(f"{name} must be one of {', '.join(domain)}, not {value!r}")
    return value


def where_all(rows: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Conjunction of the given conditions; without any, all rows."""
    given = [condition for condition in conditions if condition is not None]
    return rows.filter(reduce(Column.__and__, given)) if given else rows


def equals(column: str, value: object | None) -> Column | None:
    return None if value is None else F.col(column) == value


def at_least(column: str, value: int | None) -> Column | None:
    return None if value is None else F.col(column) >= value


def newest(rows: DataFrame, column: str, ties: Sequence[str], limit: int | None = None) -> DataFrame:
    """Descending with nulls first, ties broken by a natural key.

    With a limit Spark plans ``TakeOrderedAndProject``: every task keeps its own
    best rows and only those leave it.
    """
    ordered = rows.orderBy(F.col(column).desc_nulls_first(), *[F.col(tie).desc() for tie in ties])
    return ordered if limit is None else ordered.limit(limit)


def counts_by(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Row counts per key, most frequent first. Partial counts are made before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), *keys)
