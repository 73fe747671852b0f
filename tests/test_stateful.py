"""Correlation with the look-back as state of the stream, against the event-by-event simulation."""

from __future__ import annotations

import dataclasses
import json

from hostwarden.session import scratch_path
from hostwarden.streaming import stateful
from test_correlate import RULE_SETS, frame, live, random_rows


def test_stream_with_late_arrivals_equals_simulation(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    rows = random_rows(17, count=120, shuffled=0.1)
    rules = [dataclasses.replace(rule, rule_id=f"R{number}") for number, rule in enumerate(RULE_SETS["short_windows"])]
    inbox, found = scratch_path(spark, "inbox"), scratch_path(spark, "found")
    size = len({r[2] for r in rows}) // 2 + 1
    for number in range(2):
        part = frame(spark, [r for r in rows if r[2] // size == number])
        part.write.mode("append").parquet(inbox)
        stream = stateful.correlate_stream(spark.readStream.schema(part.schema).parquet(inbox), rules, lateness_seconds=5000)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{found}-progress")
        writer.trigger(availableNow=True).start(found).awaitTermination()
    groups = spark.read.schema(stream.schema).parquet(found).collect()
    assert {(g.rule_pos, tuple(m.finding_uuid for m in g.members)) for g in groups} == live(rows, rules)


class Rows:
    """A list state in memory."""

    def __init__(self):
        self.kept = []

    def get(self):
        return iter(self.kept)

    def put(self, rows):
        self.kept = rows


def test_state_holds_the_look_back_only():
    import pandas as pd

    rule = RULE_SETS["window_is_look_back"][0]
    processor = stateful.LookBack([rule], 0, None)
    processor.rows = Rows()
    for second in range(0, 2000, 20):
        row = (f"f{second}", second * 1_000_000, second, "H1", "sysmon", 1, None, "TP-WIN-SYSMON-0002", 1)
        part = pd.DataFrame([row], columns=stateful.STATE.fieldNames())
        (out,) = processor.handleInputRows((0, "H1", "[]"), iter([part]), None)
        assert len(processor.rows.kept) <= 6
    assert [m["finding_uuid"] for m in json.loads(out["members"][0])] == ["f1960", "f1980"]


class Groups:
    """A map state in memory."""

    def __init__(self):
        self.kept = {}

    def containsKey(self, group):
        return group in self.kept

    def getValue(self, group):
        return self.kept[group]

    def updateValue(self, group, value):
        self.kept[group] = value


def test_groups_of_records_share_a_key():
    """Many groups in one call, their findings in two batches: one evaluation each, the state apart by group."""
    import pandas as pd

    rule = dataclasses.replace(RULE_SETS["window_is_look_back"][0], group_by=("source_host", "event_record_id"))
    processor = stateful.LookBack([rule], 0, None)
    processor.groups = Groups()
    for batch in range(2):
        rows = [(f"f{batch}-{n}", (n + batch) * 1_000_000, 2 * n + batch, "H1", "sysmon", 1, n, "TP-WIN-SYSMON-0002", 1) for n in range(300)]
        part = pd.DataFrame(rows, columns=stateful.STATE.fieldNames()).assign(state_group=[f"g{n}" for n in range(300)])
        (out,) = processor.handleInputRows((0, "", "7"), iter([part[:100], part[100:]]), None)
        assert len(out) == 300 * batch and len(processor.groups.kept) == 300
    found = {tuple(m["finding_uuid"] for m in json.loads(members)) for members in out["members"]}
    assert found == {(f"f0-{n}", f"f1-{n}") for n in range(300)}
    assert [len(json.loads(value[0])) for value in processor.groups.kept.values()] == [2] * 300
