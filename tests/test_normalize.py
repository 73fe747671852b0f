"""Event XML to normalized events and stored rows."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hostwarden.operators import normalize as nz
from hostwarden.sources.telemetry import EVENT_NAMESPACE

FULL_SYSTEM = (
    "<System><Provider Name='P'/><EventID Qualifiers='1'>1001</EventID><Level>3</Level>"
    "<TimeCreated SystemTime='2026-07-29T16:00:00.1234567Z'/><EventRecordID>42</EventRecordID>"
    "<Computer>HOST-01</Computer></System>"
)


def event(body: str) -> str:
    return f"<Event xmlns='{EVENT_NAMESPACE}'>{body}</Event>"


def numbers(event_id: str = "1", record_id: str = "2") -> str:
    return event(f"<System><EventID>{event_id}</EventID><EventRecordID>{record_id}</EventRecordID></System>")


def parse(spark, *documents: str, source_type: str = "sysmon"):
    rows = [(i, xml, source_type, "C") for i, xml in enumerate(documents)]
    frame = spark.createDataFrame(rows, "i int, xml string, source_type string, channel string")
    return nz.normalize(frame, "DEFAULT", F.lit("2030-01-01").cast("timestamp"))


def parsed(spark, *documents: str):
    rows = parse(spark, *documents).withColumn("user_json", F.to_json("raw.user_data")).drop("raw.user_data")
    kept = rows.withColumn("raw", F.struct("raw.level", "raw.computer", "raw.event_data"))
    return [row for row in kept.orderBy("i").collect()]


def test_complete_event(spark):
    data = r"<EventData><Data Name='Image'>C:\Windows\test.exe</Data><Data Name='User'>DOMAIN\user</Data></EventData>"
    (row,) = parsed(spark, event(FULL_SYSTEM + data))
    assert (row.provider, row.event_id, row.record_id, row.severity, row.computer) == ("P", 1001, 42, "Warning", "HOST-01")
    assert row.time_created == datetime(2026, 7, 29, 16, 0, 0, 123456)
    assert row.message == r"Image=C:\Windows\test.exe User=DOMAIN\user"
    assert not row.is_bad


def test_levels_and_defaults(spark):
    levels = ["0", "1", "2", "3", "4", "5", "99"]
    rows = parsed(spark, *[event(f"<System><Level>{level}</Level><Computer/></System>") for level in levels])
    names = ["LogAlways", "Critical", "Error", "Warning", "Information", "Verbose", "99"]
    assert [row.severity for row in rows] == names
    bare = parsed(spark, event(""))[0]
    assert (bare.provider, bare.event_id, bare.record_id, bare.message, bare.computer) == ("", 0, 0, "", "DEFAULT")
    assert bare.raw.event_data == {} and bare.user_json == "{}" and bare.raw.computer == "DEFAULT"
    assert bare.time_created == datetime(2030, 1, 1) and not bare.is_bad


def test_event_data_names(spark):
    rows = parsed(
        spark,
        event("<EventData><Data>alpha</Data><Data>bravo</Data></EventData>"),
        event("<EventData><Data Name='A'>1</Data><Data/><Data Name='A'> 2 </Data><Data Name='B'>3</Data></EventData>"),
    )
    assert rows[0].message == "Data0=alpha Data1=bravo"
    assert rows[1].raw.event_data == {"A": " 2 ", "Data1": "", "B": "3"}
    assert rows[1].message == "A= 2  Data1= B=3"


def test_user_data_keeps_text_and_nesting(spark):
    nested = "<UserData><EventXML xmlns='x'><Name>Bob</Name><Code>007</Code><Name>Ann</Name><In><V/></In></EventXML></UserData>"
    flat = "<UserData><K>1</K><L>two</L></UserData>"
    first, second, third = parsed(
        spark, event(nested), event(flat), event(flat + "<EventData><Data Name='D'>d</Data></EventData>")
    )
    tree = {"EventXML": {"Name": "Ann", "Code": "007", "In": {"V": ""}}}
    assert json.loads(first.user_json) == tree
    assert first.message == f"EventXML={tree['EventXML']}"
    assert second.message == "K=1 L=two"
    assert third.message == "D=d"


def test_bad_documents(spark):
    good_process = event(
        "<System><EventID>1</EventID></System><EventData><Data Name='ProcessId'>x</Data></EventData>"
    )
    rows = parsed(
        spark, "<Event>", "garbage", numbers("bad"), numbers("1", "bad"), numbers(" 7 "), numbers("1.5"), good_process
    )
    assert [row.is_bad for row in rows] == [True, True, True, True, False, True, True]


def test_strict_mode_drops_the_channel(spark):
    frame = spark.createDataFrame(
        [("s", "A", numbers()), ("s", "A", "<Event>"), ("s", "B", numbers())],
        "source_type string, channel string, xml string",
    )
    events = nz.normalize(frame, "D")
    assert sorted(row.channel for row in nz.accepted(events).collect()) == ["A", "B"]
    assert [row.channel for row in nz.accepted(events, strict=True).collect()] == ["B"]
    assert nz.rejected(events).count() == 1


@pytest.mark.parametrize(
    ("hashes", "expected"),
    [("MD5=abc,SHA256=def123", "def123"), ("MD5=abc, sha256=def123 ", "def123"), ("", ""), ("XSHA256=1", ""),
     ("SHA256=a=b,SHA256=c", "a=b"), ("SHA256", "")],
)
def test_process_event(spark, hashes, expected):
    fields = {"ProcessGuid": "{guid}", "ProcessId": "1234", "Image": "i.exe", "Hashes": hashes}
    data = "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in fields.items())
    events = parse(spark, event(f"<System><EventID>1</EventID></System><EventData>{data}</EventData>"))
    (row,) = nz.to_process_events(events).collect()
    assert (row.process_guid, row.process_id, row.image, row.command_line, row.sha256) == ("{guid}", 1234, "i.exe", "", expected)
    assert nz.to_process_events(events.withColumn("source_type", F.lit("windows_system"))).count() == 0


def test_unavailable_metrics_are_skipped(spark):
    frame = spark.createDataFrame(
        [("h", True, 10.0, 50.0, 60.0, "2026-01-01T00:00:00+00:00"), ("h", False, None, None, None, None)],
        "host string, psutil_available boolean, cpu_percent double, memory_percent double, disk_percent double, boot_time string",
    )
    (row,) = nz.to_host_metrics(frame).collect()
    assert (row.host_name, row.cpu_percent, row.boot_time) == ("h", 10.0, datetime(2026, 1, 1))
