"""Registered queries against their SQL. HOSTWARDEN_ALL_QUERIES=1 runs every one of them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from compare import database, differences
from hostwarden.plans.oracles import ORACLES as SQL
from hostwarden.plans.registry import QUERIES

FOLDER = os.environ.get("HOSTWARDEN_SF_DIR", "/root/testdata/sf0.001")
CORE = (
    "s02_after_checkpoint", "s03_next_batch", "s04_advance_checkpoints", "s13_arrival_order", "n01_parse_events",
    "n04_event_data", "n10_raw_json", "d01_all_rules", "d07_contains_any_token", "d10_null_case_text",
    "d16_insert_if_new", "d16b_first_arrivals", "c02_same_event", "c03_full_history_3600", "c04_anchored_3600",
    "c04_anchored_short_window", "c04_anchored_late_arrivals", "c13_new_finding_required", "c14_look_back",
    "r02_providers", "a03_alerts", "q01_latest_logs", "q05b_search_escaped", "q06_logs_of_source", "q12_alerts",
    "b10_collector_history", "b17_highest_risk", "b23_investigation_chain", "b24_activity_by_host",
    "v05_required_columns", "v06b_unique_ids", "u02_custom_correlation_rule",
)
NAMES = sorted(QUERIES) if os.environ.get("HOSTWARDEN_ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    problem = differences(name, QUERIES[name](spark, FOLDER), SQL[name], connection)
    assert problem is None, problem


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() > 0
