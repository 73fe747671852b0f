"""Live correlation with the look-back kept as state of the stream.

``Ingestion`` reads the look-back of a batch from the stored findings. Here it stays in the
state store, a list of findings for each rule and group, so a trigger reads nothing that is
stored and its cost follows the batch, not the history. The store must keep state larger
than memory, so the session needs Spark's RocksDB provider.

A group of a rule that groups by host alone is one key, and one task evaluates its new
findings. That suits many hosts of bounded rate; ``Ingestion`` also splits a single host that
holds most of the findings. The groups of other rules may be as many as the findings: they
share a fixed number of keys, which hold a map from group to findings. The new findings of a key
are evaluated together, and only groups that have any are read and written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hostwarden.operators.anchored import matches_of_rule, per_rule
from hostwarden.operators.correlate import CorrelationRule, look_back_seconds, refs, validate_correlation_rules
from hostwarden.operators.temporal import KERNEL_FIELDS, KERNEL_REF, from_kernel

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUP_KEY = ["rule_pos", "source_host", "group_key"]
STATE_KEY = ["rule_pos", "state_host", "state_key"]
#: Keys that the groups of a rule share; a stream must keep its number.
BUCKETS = 256
# Built from types, not from DDL: workers import this module without a session.
STATE = T.StructType(
    [
        *[T.StructField("finding_uuid", T.StringType()), T.StructField("event_us", T.LongType()), T.StructField("arrival_seq", T.LongType())],
        *[T.StructField("source_host", T.StringType()), T.StructField("source_type", T.StringType())],
        *[T.StructField("event_id", T.LongType()), T.StructField("event_record_id", T.LongType())],
        *[T.StructField("rule_id", T.StringType()), T.StructField("rule_version", T.IntegerType())],
    ]
)
GROUP = T.StructType([T.StructField("state_group", T.StringType())])
KEPT = T.StructType([T.StructField("findings", T.StringType())])
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
_TABLE = pa.schema([(field.name, _KINDS[field.dataType.simpleString()]) for field in STATE.fields])


class LookBack(StatefulProcessor):
    """The findings of a group that later ones can look back on."""

    def __init__(self, rules: Sequence[CorrelationRule], lateness_seconds: int, idle_seconds: int | None) -> None:
        self.rules, self.length = list(rules), look_back_seconds(rules) * 1_000_000
        self.kept = self.length + lateness_seconds * 1_000_000
        self.idle = None if idle_seconds is None else idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", STATE, self.idle)
        self.groups = handle.getMapState("groups", GROUP, KEPT, self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        pos, parts = key[0], list(rows)
        rule, new = self.rules[pos], pa.concat_tables([_plain(part) for part in parts])
        if _by_host(rule):
            both, old = self._with_old(new, [tuple(row) for row in self.rows.get()])
            self.rows.put(_rows(both.filter(_recent(both, np.zeros(len(both), dtype=np.int64), self.kept))))
        else:
            both, old = self._grouped(new, np.concatenate([part["state_group"].to_numpy() for part in parts]))
        found = _matches(both, old, pos, rule, self.length)
        yield pd.DataFrame({"rule_pos": np.full(len(found), pos, dtype=np.int32), "members": pd.Series([json.dumps(members) for members in found], dtype=object)})

    def _with_old(self, new: pa.Table, old: list[tuple]) -> tuple[pa.Table, int]:
        columns = zip(*old, strict=True) if old else [()] * len(_TABLE)
        kept = pa.table([pa.array(values, field.type) for values, field in zip(columns, _TABLE, strict=True)], schema=_TABLE)
        return pa.concat_tables([kept, new]).combine_chunks(), len(old)

    def _grouped(self, new: pa.Table, names: np.ndarray) -> tuple[pa.Table, int]:
        """The new findings behind the old ones of their groups, whose states are brought up to date."""
        groups, number = np.unique(names.astype(str), return_inverse=True)
        old, owner = [], []
        for place, group in enumerate(groups.tolist()):
            if self.groups.containsKey((group,)):
                kept = json.loads(self.groups.getValue((group,))[0])
                old += [tuple(row) for row in kept]
                owner += [place] * len(kept)
        both, before = self._with_old(new, old)
        number = np.concatenate([np.array(owner, dtype=np.int64), number.reshape(-1)])
        recent = _recent(both, number, self.kept)
        number, rows = number[recent], _rows(both.filter(recent))
        order = np.argsort(number, kind="stable")
        ends = np.searchsorted(number[order], np.arange(1, len(groups) + 1))
        for group, start, end in zip(groups.tolist(), [0, *ends.tolist()], ends.tolist()):
            self.groups.updateValue((group,), (json.dumps([rows[at] for at in order[start:end]]),))
        return both, before

    def close(self) -> None:
        pass


def _by_host(rule: CorrelationRule) -> bool:
    return set(rule.group_by) == {"source_host"}


def _plain(part: pd.DataFrame) -> pa.Table:
    return pa.Table.from_pandas(part[_TABLE.names], schema=_TABLE, preserve_index=False).replace_schema_metadata()


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*[column.to_pylist() for column in table.columns], strict=True))


def _recent(table: pa.Table, group: np.ndarray, kept: int) -> np.ndarray:
    """Findings that are at most ``kept`` older than the newest of their group."""
    times = table.column("event_us").to_numpy()
    newest = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).min)
    np.maximum.at(newest, group, times)
    return times >= newest[group] - kept


def _matches(both: pa.Table, old: int, pos: int, rule: CorrelationRule, length: int) -> list[list[dict]]:
    """Members of the matches that findings behind the ``old`` ones complete: every finding in its own slice and, as context, in the next."""
    home = both.column("event_us").to_numpy() // length
    is_new = pa.array(np.arange(len(both)) >= old)
    slices = [
        both.append_column("is_new", is_new).append_column("own", pa.array(np.full(len(both), step == 0))).append_column("slice", pa.array(home + step))
        for step in (0, 1)
    ]
    return matches_of_rule(pa.concat_tables(slices).combine_chunks(), pos, rule, length).column("members").to_pylist()


def correlate_stream(
    findings: DataFrame, rules: Sequence[CorrelationRule], lateness_seconds: int = 0, idle_seconds: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """A stream of new findings -> ``(rule_pos, members)`` of the matches that they complete.

    A finding up to ``lateness_seconds`` older than the newest of its group looks back on all
    that had arrived; an older one may miss what has left the state. ``idle_seconds``
    forgets groups without findings for that long by the clock; None keeps them.
    ``buckets`` is part of the state's layout: a stream keeps the one it began with.
    """
    validate_correlation_rules(rules)
    rows = per_rule(refs(findings).withColumn("is_new", F.lit(True)), rules)
    alone = F.col("rule_pos").isin(*[pos for pos, rule in enumerate(rules) if _by_host(rule)])
    bucket = F.pmod(F.xxhash64(*GROUP_KEY), F.lit(buckets)).cast("string")
    rows = rows.select(
        "rule_pos",
        F.when(alone, F.col("source_host")).otherwise("").alias("state_host"),
        F.when(alone, F.col("group_key")).otherwise(bucket).alias("state_key"),
        F.to_json(F.array("source_host", "group_key")).alias("state_group"),
        *KERNEL_FIELDS,
    )
    processor = LookBack(rules, lateness_seconds, idle_seconds)
    mode = "None" if idle_seconds is None else "ProcessingTime"
    found = rows.groupBy(*STATE_KEY).transformWithStateInPandas(processor, "rule_pos int, members string", "Append", mode)
    return from_kernel(found.withColumn("members", F.from_json("members", f"array<{KERNEL_REF}>")))
