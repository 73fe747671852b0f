"""Detection rules against a plain Python reading of the conditions."""

from __future__ import annotations

import dataclasses
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hostwarden.functions.text import fold
from hostwarden.operators.detect import FieldCondition, condition_matches, detect, validate_rules
from hostwarden.operators.detection_rules import BUILTIN_DETECTION_RULES, ENCODED_POWERSHELL, POWERSHELL_PROCESS
from hostwarden.operators.findings import findings_from_text, findings_to_text, insert_if_new, recent_findings

POWERSHELL = r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe"
SCHEMA = (
    "computer string, source_type string, event_id bigint, record_id bigint, time_created timestamp, arrival_seq bigint,"
    " raw struct<event_data: map<string, string>>"
)


def events(spark, *changes: dict):
    rows = []
    for number, change in enumerate(changes):
        given = {"source_type": "sysmon", "event_id": 1, "image": POWERSHELL, "command": "powershell.exe Get-Process", **change}
        data = {"Image": given["image"], "CommandLine": given["command"]} if given["image"] else {}
        rows.append(("HOST-01", given["source_type"], given["event_id"], 100 + number, datetime(2026, 1, 1), number, (data,)))
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, *changes: dict, rules=BUILTIN_DETECTION_RULES):
    rows = detect(events(spark, *changes), rules).select("event_record_id", "rule_id").collect()
    return [sorted(r.rule_id[-4:] for r in rows if r.event_record_id == 100 + i) for i in range(len(changes))]


def test_builtin_rules(spark):
    switches = ["-EncodedCommand SQBF", "-enc x", "-ENC x", "/enc x", '"-enc"; x', "(/EncodedCommand)"]
    cases = [{"command": f"powershell.exe {switch}"} for switch in switches]
    others = [
        {}, {"command": "powershell.exe -encx no"}, {"image": "notepad.exe"}, {"source_type": "windows_system"},
        {"event_id": 3}, {"image": None}, {"event_id": None},
    ]
    assert found(spark, *cases) == [["0001", "0002"]] * len(cases)
    assert found(spark, *others) == [["0001"], ["0001"], [], [], [], [], []]


def test_disabled_rules_and_missing_event_id(spark):
    off = dataclasses.replace(POWERSHELL_PROCESS, enabled=False)
    assert found(spark, {}, rules=[off]) == [[]]
    assert found(spark, {}, rules=[]) == [[]]
    zero = dataclasses.replace(POWERSHELL_PROCESS, event_id=0)
    assert found(spark, {"event_id": None}, rules=[zero]) == [["0001"]]


def test_evidence_keeps_the_original_value(spark):
    row = detect(events(spark, {"command": "PowerShell.EXE -Enc AbC"}), [ENCODED_POWERSHELL]).head()
    assert row.evidence == {"raw.event_data.Image": POWERSHELL, "raw.event_data.CommandLine": "PowerShell.EXE -Enc AbC"}
    assert row.investigation_steps == list(ENCODED_POWERSHELL.investigation_steps)
    assert row.explanation == ENCODED_POWERSHELL.explanation and row.severity == "medium"


TEXTS = ["", " ", "abc", "ABC def", "x'abc',", "Straße", "STRASSE", "ﬁle.EXE", "a\u00a0abc\u2003b", "a\x1cabc", "((abc))", "ΑΣ", "ſet", None]
VALUES = [(), ("abc",), ("ABC", "def"), ("strasse",), ("",), ("file.exe",), ("ας",), ("set", "x")]


def expected(operator: str, text, values, sensitive: bool) -> bool:
    if text is None:
        return False
    if not sensitive:
        text, values = text.casefold(), tuple(v.casefold() for v in values)
    parts = {token.strip("\"'(),;") for token in text.split()}
    return {
        "equals": text in values,
        "contains": all(v in text for v in values),
        "contains_any": any(v in text for v in values),
        "contains_any_token": any(v in parts for v in values),
        "ends_with": all(text.endswith(v) for v in values),
        "ends_with_any": any(text.endswith(v) for v in values),
    }[operator]


@pytest.mark.parametrize("operator", ["equals", "contains", "contains_any", "contains_any_token", "ends_with", "ends_with_any"])
def test_operators(spark, operator):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    cases = [(values, sensitive) for values in VALUES for sensitive in (False, True)]
    columns = []
    for number, (values, sensitive) in enumerate(cases):
        text = F.col("t") if sensitive else fold(F.col("t"))
        columns.append(condition_matches(text, FieldCondition("t", operator, values, sensitive)).alias(f"c{number}"))
    for row in frame.select("t", *columns).collect():
        for number, (values, sensitive) in enumerate(cases):
            assert row[f"c{number}"] == expected(operator, row.t, values, sensitive), (operator, row.t, values, sensitive)


@pytest.mark.parametrize(
    "change",
    [{"rule_id": " "}, {"version": 0}, {"conditions": ()}, {"severity": "severe"},
     {"conditions": (FieldCondition("x", "matches", ("a",)),)}],
)
def test_invalid_rules(change):
    with pytest.raises(ValueError):
        validate_rules([dataclasses.replace(POWERSHELL_PROCESS, **change)])
    with pytest.raises(ValueError):
        validate_rules([POWERSHELL_PROCESS, POWERSHELL_PROCESS])


def test_insert_if_new(spark):
    first = detect(events(spark, {}, {}), [POWERSHELL_PROCESS])
    again = first.withColumn("arrival_seq", F.col("arrival_seq") + 10)
    assert insert_if_new(first.unionByName(again), None).count() == 2
    assert insert_if_new(again, first.limit(1)).count() == 1
    keyless = first.withColumn("event_record_id", F.lit(None).cast("bigint"))
    again = keyless.withColumn("arrival_seq", F.col("arrival_seq") + 10)
    assert insert_if_new(keyless.unionByName(again), keyless).count() == 4


def test_recent_and_typed_findings(spark):
    rows = detect(events(spark, {}, {}), [POWERSHELL_PROCESS], lambda time: time)
    moment = F.lit(datetime(2026, 1, 1))
    assert recent_findings(rows, "HOST-01", ["TP-WIN-SYSMON-0001"], moment, moment).count() == 2
    assert recent_findings(rows, "HOST-01", [], moment, moment).count() == 0
    typed = findings_from_text(findings_to_text(rows))
    assert sorted(map(str, typed.collect())) == sorted(map(str, rows.collect()))
