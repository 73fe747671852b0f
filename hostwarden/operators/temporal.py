"""Temporal-count correlation over the full history.

A match ends at row ``e`` of a group (ordered by event time) when the last ``m``
rows up to ``e`` lie within the window and none of them is used by the match
before. So only one number passes from row to row: how many of the next rows may
not end a match yet. That makes the scan a small state machine, and the effect of
a whole chunk of rows is a table from its entry state to its exit state. Chunks
are summarised in parallel, the chunk tables are chained, and a second parallel
pass emits the matches. A host that holds most rows is many chunks, not one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.operators.correlate import (
    REF_FIELDS,
    REF_TYPE,
    CorrelationRule,
    of_rules,
    refs,
    without_copies,
)
from hostwarden.operators.ranking import global_positions, in_chunks

CHUNK_ROWS = 100_000

# Refs as they travel through Arrow: the time in microseconds.
KERNEL_REF = REF_TYPE.replace("event_time: timestamp", "event_us: bigint")
KERNEL_FIELDS = [field if field != "event_time" else "event_us" for field in REF_FIELDS]


def to_kernel(findings: DataFrame) -> DataFrame:
    """Event time as microseconds."""
    return findings.withColumn("event_us", F.unix_micros("event_time")).drop("event_time")


def from_kernel(groups: DataFrame) -> DataFrame:
    """Members with the event time as a timestamp again."""
    member = lambda m: F.struct(
        *[
            F.timestamp_micros(m["event_us"]).alias("event_time") if f == "event_time" else m[f].alias(f)
            for f in REF_FIELDS
        ]
    )
    return groups.withColumn("members", F.transform("members", member))


def member_lists(table: pa.Table, rows: np.ndarray) -> pa.Array:
    """``rows[k]`` are the row numbers of list ``k`` -> list<struct> of refs."""
    flat = pa.array(rows.ravel())
    columns = [table.column(name).combine_chunks().take(flat) for name in KERNEL_FIELDS]
    offsets = pa.array(np.arange(rows.shape[0] + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, KERNEL_FIELDS))


def codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """One dense number per distinct combination of the named columns."""
    combined = np.zeros(table.num_rows, dtype=np.int64)
    for name in names:
        encoded = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        combined = combined * (len(encoded.dictionary) + 1) + code
        combined = np.unique(combined, return_inverse=True)[1].reshape(-1)
    return combined


def next_true(flags: np.ndarray) -> np.ndarray:
    """For every place, and one past the end, the first true place from there on (n if none)."""
    count = len(flags)
    places = np.where(flags, np.arange(count), count)
    following = np.append(places, count)
    return np.minimum.accumulate(following[::-1])[::-1]


def reaches(following: np.ndarray, place: np.ndarray, target: np.ndarray, step: int) -> np.ndarray:
    """Whether the greedy scan that ends its first window at ``place`` ends one at ``target``, too.

    ``following`` holds the first possible end from each row on. The hop to the next window is
    doubled, and a target is reached when the farthest hop not beyond it is itself.
    """
    count = len(following) - 1
    hops = [np.append(following[np.minimum(np.arange(count) + step, count)], count)]
    reach = int((target - place).max(initial=0)) // step
    while (1 << len(hops)) <= reach:
        hops.append(hops[-1][hops[-1]])
    for hop in reversed(hops):
        ahead = hop[place]
        place = np.where(ahead <= target, ahead, place)
    return place == target


def _possible_ends(table: pa.Table, rule: CorrelationRule) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The chunk in order, its own rows, and for each of them whether a match could end there."""
    table = table.take(np.argsort(table.column("position").to_numpy(), kind="stable"))
    times = table.column("event_us").to_numpy()
    group = codes(table, list(rule.group_by))
    back = rule.minimum_matches - 1
    fits = np.zeros(table.num_rows, dtype=bool)
    if back < table.num_rows:
        first, last = slice(0, table.num_rows - back), slice(back, None)
        in_window = times[last] - times[first] <= rule.window_seconds * 1_000_000
        fits[last] = in_window & (group[last] == group[first])
    own = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False))
    return table, own, fits[own]


def walk(following: np.ndarray, wait: int, step: int) -> tuple[list[int], int]:
    """Chosen ends of a chunk entered with ``wait``, and the wait it leaves behind."""
    count = len(following) - 1
    chosen, place = [], int(following[min(wait, count)])
    while place < count:
        chosen.append(place)
        place = int(following[min(place + step, count)])
    left = chosen[-1] + step - count if chosen else wait - count
    return chosen, max(left, 0)


def full_history_groups(
    findings: DataFrame, rule: CorrelationRule, rule_pos: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Greedy, non-overlapping windows over all findings -> ``(rule_pos, members)``."""
    step = rule.minimum_matches
    fields = list(rule.group_by)
    eligible = to_kernel(
        without_copies(of_rules(refs(findings), rule.required_detection_rule_ids, fields))
    )
    ties = ["event_us", "arrival_seq", "rule_id", "rule_version", "finding_uuid"]
    numbered = global_positions(eligible, list(dict.fromkeys([*fields, *ties])), "position")

    chunked = in_chunks(numbered, chunk_rows, step - 1)

    def summarise(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, own, ends = _possible_ends(table, rule)
        if not len(own):
            return pa.table({"chunk": pa.array([], pa.int64()), "exits": pa.array([], pa.list_(pa.int64()))})
        following = next_true(ends)
        exits = [walk(following, wait, step)[1] for wait in range(step)]
        return pa.table({"chunk": [chunk], "exits": pa.array([exits], pa.list_(pa.int64()))})

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        wait, entries = 0, []
        for exits in table.column("exits").to_pylist():
            entries.append(wait)
            wait = exits[wait]
        return pa.table({"chunk": table.column("chunk"), "entry": pa.array(entries, pa.int64())})

    narrow = chunked.select("chunk", "own", "position", "event_us", *fields)
    exits = narrow.groupBy("chunk").applyInArrow(summarise, "chunk bigint, exits array<bigint>")
    # One row per chunk of rows, so a single task chains them.
    entries = exits.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(chain, "chunk bigint, entry bigint")

    def emit(table: pa.Table) -> pa.Table:
        wait = table.column("entry")[0].as_py()
        table, own, ends = _possible_ends(table, rule)
        chosen, _ = walk(next_true(ends), wait, step)
        last = own[np.array(chosen, dtype=np.int64)]
        rows = last[:, None] + np.arange(-step + 1, 1)[None, :]
        return pa.table(
            {
                "rule_pos": pa.array(np.full(len(last), rule_pos, dtype=np.int32)),
                "members": member_lists(table, rows),
            }
        )

    kernel_schema = f"rule_pos int, members array<{KERNEL_REF}>"
    # A chunk without own rows (only the tail of the one before) has no entry and drops out.
    groups = chunked.join(entries, "chunk").groupBy("chunk").applyInArrow(emit, kernel_schema)
    return from_kernel(groups)
