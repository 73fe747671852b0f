"""Correlation against a plain simulation, event by event."""

from __future__ import annotations

import dataclasses
import random
from collections import defaultdict
from datetime import datetime, timedelta
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from hostwarden.operators.anchored import anchored_groups, candidate_counts
from hostwarden.operators import anchored as anchored_module, hot_slices
from hostwarden.operators.correlate import match_rows, same_event_groups, validate_correlation_rules
from hostwarden.operators.correlation_rules import BUILTIN_CORRELATION_RULES, ENCODED_EXECUTION, REPEATED_ENCODED
from hostwarden.operators.temporal import full_history_groups
from hostwarden.plans.chain import correlate_history, correlate_new

START = datetime(2026, 1, 1)
GENERAL, ENCODED = "TP-WIN-SYSMON-0001", "TP-WIN-SYSMON-0002"
SCHEMA = (
    "finding_uuid string, event_time timestamp, arrival_seq bigint, source_host string, source_type string,"
    " event_id bigint, event_record_id bigint, rule_id string, rule_version int"
)


def finding(number, seconds, rule=ENCODED, host="H1", record=..., arrival=None):
    return (
        f"f{number:05d}", START + timedelta(seconds=seconds), number if arrival is None else arrival, host, "sysmon", 1,
        number if record is ... else record, rule, 1,
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def members(groups):
    return sorted(tuple(m.finding_uuid for m in row.members) for row in groups.collect())


def by_time(rows):
    return sorted(rows, key=lambda r: (r[1], r[2], r[7]))


def grouped(rows, rule):
    place = {name: i for i, name in enumerate(SCHEMA.replace(",", "").split()[::2])}
    groups = defaultdict(list)
    for row in rows:
        key = tuple(row[place[name]] for name in rule.group_by)
        if None not in key:
            groups[key].append(row)
    return groups.values()


def greedy(rows, rule):
    out = []
    for group in grouped([r for r in by_time(rows) if r[7] in rule.required_detection_rule_ids], rule):
        current = []
        for row in group:
            current = [r for r in current if row[1] - r[1] <= timedelta(seconds=rule.window_seconds)] + [row]
            if len(current) >= rule.minimum_matches:
                out.append(tuple(r[0] for r in current))
                current = []
    return out


def firsts(rows, rule):
    out = []
    for group in grouped(by_time(rows), rule):
        chosen = [next((r for r in group if r[7] == q), None) for q in rule.required_detection_rule_ids]
        if None in chosen or len(chosen) < rule.minimum_matches:
            continue
        if max(r[1] for r in chosen) - min(r[1] for r in chosen) <= timedelta(seconds=rule.window_seconds):
            out.append(tuple(r[0] for r in sorted(chosen, key=lambda r: r[1])))
    return out


def evaluate(rows, rule):
    return greedy(rows, rule) if rule.mode == "temporal_count" else firsts(rows, rule)


def live(rows, rules, known=()):
    """Findings arrive event by event; each looks back over what is there."""
    look_back = timedelta(seconds=max(rule.window_seconds for rule in rules))
    out, stored = set(), list(known)
    for arrival in sorted({r[2] for r in rows}):
        new = [r for r in rows if r[2] == arrival]
        stored += new
        for trigger in new:
            seen = [r for r in stored if r[3] == trigger[3] and trigger[1] - look_back <= r[1] <= trigger[1]]
            for number, rule in enumerate(rules):
                for match in evaluate(seen, rule) if rule.enabled else ():
                    if {r[0] for r in new} & set(match):
                        out.add((number, match))
    return out


def anchored(spark, rows, rules, known=(), cells=5):
    history = frame(spark, known) if known else None
    groups = anchored_groups(frame(spark, rows), rules, history, cells)
    return {(row.rule_pos, tuple(m.finding_uuid for m in row.members)) for row in groups.collect()}


def random_rows(seed, count=250, span=2500, shuffled=0.0, ties=True):
    rng = random.Random(seed)
    rows, number = [], 0
    times = sorted(rng.randrange(span) if ties else rng.random() * span for _ in range(count))
    order = list(range(count))
    for i in range(count):
        if rng.random() < shuffled:
            j = rng.randrange(count)
            order[i], order[j] = order[j], order[i]
    for place, seconds in enumerate(times):
        host = rng.choice(["H1", "H1", "H1", "H2"])
        record = None if rng.random() < 0.1 else rng.randrange(40)
        for rule in rng.choice([(GENERAL,), (ENCODED,), (GENERAL, ENCODED)]):
            rows.append(finding(number, seconds, rule, host, record, order[place]))
            number += 1
    return rows


def test_same_event(spark):
    pair = [finding(1, 0, GENERAL, record=100), finding(2, 0, ENCODED, record=100)]
    apart = [finding(1, 0, GENERAL, record=100), finding(2, 0, ENCODED, record=101)]
    hosts = [finding(1, 0, GENERAL, record=100), finding(2, 0, ENCODED, "H2", record=100)]
    for rows, count in ((pair, 1), (apart, 0), (hosts, 0)):
        assert same_event_groups(frame(spark, rows), ENCODED_EXECUTION, 0).count() == count
        assert len(anchored(spark, rows, [ENCODED_EXECUTION])) == count


@pytest.mark.parametrize(
    ("seconds", "full", "live_result"),
    [
        ((0, 300), [(0, 1)], [(0, 1)]),
        ((0, 601), [], []),
        ((0, 600), [(0, 1)], [(0, 1)]),
        ((0, 300, 500, 650, 700), [(0, 1), (2, 3)], [(0, 1), (3, 4)]),
    ],
)
def test_repeated_activity(spark, seconds, full, live_result):
    rows = [finding(i, s) for i, s in enumerate(seconds)]
    name = lambda pairs: [tuple(f"f{i:05d}" for i in pair) for pair in pairs]
    assert members(full_history_groups(frame(spark, rows), REPEATED_ENCODED, 0)) == name(full)
    assert sorted(m for _, m in anchored(spark, rows, [REPEATED_ENCODED])) == name(live_result)


def test_late_arrival_looks_back_only(spark):
    rows = [finding(0, 0, arrival=0), finding(1, 500, arrival=1), finding(2, 250, arrival=2)]
    found = sorted(m for _, m in anchored(spark, rows, [REPEATED_ENCODED]))
    assert found == [("f00000", "f00001"), ("f00000", "f00002")]


def test_match_needs_a_new_finding(spark):
    known = [finding(0, 0), finding(1, 60)]
    assert anchored(spark, [finding(2, 300)], [REPEATED_ENCODED], known) == set()
    assert len(anchored(spark, [finding(2, 300), finding(3, 301)], [REPEATED_ENCODED], known)) == 1


def test_replayed_event_is_no_repetition(spark):
    rows = frame(spark, [finding(0, 0, record=7), finding(1, 0, record=7)])
    assert full_history_groups(rows, REPEATED_ENCODED, 0).count() == 0


@pytest.mark.parametrize("minimum", [1, 2, 3, 5])
@pytest.mark.parametrize("chunk_rows", [4, 17, 100_000])
def test_full_history_equals_simulation(spark, minimum, chunk_rows):
    rows = [r[:6] + (i,) + r[7:] for i, r in enumerate(random_rows(minimum))]
    rule = dataclasses.replace(
        REPEATED_ENCODED, minimum_matches=minimum, window_seconds=40, required_detection_rule_ids=(GENERAL, ENCODED)
    )
    found = members(full_history_groups(frame(spark, rows), rule, 0, chunk_rows))
    assert found == sorted(greedy(rows, rule))


RULE_SETS = {
    "window_is_look_back": [dataclasses.replace(REPEATED_ENCODED, window_seconds=100)],
    "three": [dataclasses.replace(REPEATED_ENCODED, window_seconds=100, minimum_matches=3)],
    "short_windows": [
        dataclasses.replace(REPEATED_ENCODED, window_seconds=30, minimum_matches=3,
                            required_detection_rule_ids=(GENERAL, ENCODED)),
        dataclasses.replace(REPEATED_ENCODED, window_seconds=12, group_by=("source_host", "rule_id"),
                            required_detection_rule_ids=(GENERAL, ENCODED)),
        dataclasses.replace(REPEATED_ENCODED, window_seconds=150, enabled=False),
        ENCODED_EXECUTION,
        dataclasses.replace(ENCODED_EXECUTION, group_by=("source_host",), window_seconds=20),
    ],
}


@pytest.mark.parametrize("name", RULE_SETS)
@pytest.mark.parametrize("shuffled", [0.0, 0.1, 1.0])
def test_anchored_equals_simulation(spark, name, shuffled):
    rows = random_rows(11, shuffled=shuffled)
    expected = live(rows, RULE_SETS[name])
    assert expected and anchored(spark, rows, RULE_SETS[name]) == expected


@pytest.mark.parametrize("name", ["window_is_look_back", "three"])
@pytest.mark.parametrize("shuffled", [0.0, 0.02])
def test_hot_slices_equal_simulation(spark, monkeypatch, name, shuffled):
    """Every slice with more than five findings counts as hot; some have late arrivals."""
    counted = []
    monkeypatch.setattr(hot_slices, "CHUNK_ROWS", 13)
    monkeypatch.setattr(anchored_module, "hot_groups", lambda *a: counted.append(1) or hot_slices.hot_groups(*a))
    rows, rules = random_rows(21, shuffled=shuffled), RULE_SETS[name]
    middle = len({r[2] for r in rows}) // 3
    known, new = [r for r in rows if r[2] < middle], [r for r in rows if r[2] >= middle]
    groups = anchored_groups(frame(spark, new), rules, frame(spark, known), 3, hot_rows=5)
    found = [(row.rule_pos, tuple(m.finding_uuid for m in row.members)) for row in groups.collect()]
    assert counted and len(found) == len(set(found)) and set(found) == live(new, rules, known)


@pytest.mark.parametrize("shuffled", [0.0, 0.02])
def test_hot_slices_of_all_kinds_of_rules(spark, monkeypatch, shuffled):
    """Windows shorter than the look-back and same-event rules, one host with nine tenths of the rows."""
    kinds = []
    for name in ("_by_chunks", "_first_of_rules"):
        monkeypatch.setattr(hot_slices, name, lambda *a, run=getattr(hot_slices, name), name=name: kinds.append(name) or run(*a))
    monkeypatch.setattr(hot_slices, "CHUNK_ROWS", 7)
    rules = RULE_SETS["short_windows"]
    rows = [r[:3] + ("H1" if i % 10 else "H2",) + r[4:] for i, r in enumerate(random_rows(33, shuffled=shuffled))]
    middle = len({r[2] for r in rows}) // 4
    known, new = [r for r in rows if r[2] < middle], [r for r in rows if r[2] >= middle]
    groups = anchored_groups(frame(spark, new), rules, frame(spark, known), 3, hot_rows=9)
    found = [(row.rule_pos, tuple(m.finding_uuid for m in row.members)) for row in groups.collect()]
    assert set(kinds) == {"_by_chunks", "_first_of_rules"}
    assert len(found) == len(set(found)) and set(found) == live(new, rules, known)


def test_anchored_with_history_equals_simulation(spark):
    rules = RULE_SETS["short_windows"]
    rows = random_rows(5, shuffled=0.2)
    middle = len({r[2] for r in rows}) // 2
    known, new = [r for r in rows if r[2] < middle], [r for r in rows if r[2] >= middle]
    assert anchored(spark, new, rules, known) == live(new, rules, known)


def test_candidate_counts(spark):
    rows = random_rows(3, shuffled=0.3)
    rules = RULE_SETS["short_windows"]
    look_back = timedelta(seconds=150)
    counts = {r.finding_uuid: r.candidates for r in candidate_counts(frame(spark, rows), rules, 3).collect()}
    for row in rows:
        seen = [r for r in rows if r[3] == row[3] and row[1] - look_back <= r[1] <= row[1] and r[2] <= row[2]]
        assert counts[row[0]] == len(seen)


def test_keys_and_replays(spark):
    rows = frame(spark, [finding(1, 0, record=None), finding(2, 10, record=100)])
    (row,) = match_rows(anchored_groups(rows, [REPEATED_ENCODED]), [REPEATED_ENCODED]).collect()
    keys = sorted([f"H1|sysmon|1|None|{ENCODED}|1", f"H1|sysmon|1|100|{ENCODED}|1"])
    text = "|".join(["TP-CORR-WIN-0002", "1", "H1", *keys])
    assert row.correlation_key == sha256(text.encode()).hexdigest()
    assert row.evidence == '{"finding_count":2,"group_key":["H1"],"window_seconds":600}'
    renamed = rows.withColumn("finding_uuid", F.concat(F.lit("x"), "finding_uuid"))
    stored = match_rows(anchored_groups(renamed, [REPEATED_ENCODED]), [REPEATED_ENCODED])
    assert correlate_new(rows, [REPEATED_ENCODED], stored_matches=stored).count() == 0


def test_history_in_rule_order_and_without_rules(spark):
    rows = frame(spark, random_rows(9))
    found = correlate_history(rows, BUILTIN_CORRELATION_RULES)
    assert {r.rule_pos for r in found.select("rule_pos").distinct().collect()} == {0, 1}
    assert correlate_history(rows, []).count() == 0


@pytest.mark.parametrize(
    "change",
    [{"rule_id": ""}, {"version": 0}, {"required_detection_rule_ids": ()}, {"group_by": ()}, {"group_by": ("title",)},
     {"window_seconds": 0}, {"minimum_matches": 0}, {"mode": "sequence"}, {"severity": "x"}, {"minimum_matches": 1}],
)
def test_invalid_correlation_rules(change):
    with pytest.raises(ValueError):
        validate_correlation_rules([dataclasses.replace(ENCODED_EXECUTION, **change)])
    with pytest.raises(ValueError):
        validate_correlation_rules([ENCODED_EXECUTION, ENCODED_EXECUTION])
