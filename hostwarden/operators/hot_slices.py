"""Slices of one group that hold too many findings for one task, split by position.

The findings are sorted in range partitions together with a probe at the start of each
look-back, and running counts give the position of every finding and of the first one in its
look-back. No group is brought to one place. Then, by the kind of rule:

- When the window is as long as the look-back, every ``m`` findings in a look-back fit one window.
  The greedy scan takes them in blocks of ``m``, so a finding completes a match exactly when the
  number of findings in its look-back is a multiple of ``m``.
- With a shorter window only one number passes from row to row: how many of the next rows may not
  end a window. Chunks of rows are summarised side by side: what a scan that starts at a row
  leaves behind, what entering with each number leaves behind, and which rows it ends windows at.
  The chunks between a look-back's first and a trigger's own are composed, a table for each pair.
- The first finding of a required rule in a look-back is the one whose number among the findings of
  that rule is the probe's count of them.

This holds while findings arrive in the order they happened. Slices with late arrivals stay
with the per-cell pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from hostwarden.operators.correlate import CorrelationRule
from hostwarden.operators.ranking import global_positions, global_running_count, in_chunks
from hostwarden.operators.temporal import CHUNK_ROWS, KERNEL_FIELDS, KERNEL_REF, codes, member_lists, next_true, reaches, walk

_ORDER = ["event_us", "arrival_seq", "rule_id", "rule_version"]


def _with_closed_form(rules: Sequence[CorrelationRule], length: int) -> list[int]:
    return [
        pos
        for pos, rule in enumerate(rules)
        if rule.enabled and rule.mode == "temporal_count" and rule.window_seconds * 1_000_000 == length
    ]


def _with_chunks(rules: Sequence[CorrelationRule], length: int) -> list[int]:
    closed = _with_closed_form(rules, length)
    return [pos for pos, rule in enumerate(rules) if rule.enabled and rule.mode == "temporal_count" and pos not in closed]


def hot_slices(sliced: DataFrame, key: list[str], hot_rows: int) -> tuple[int, DataFrame | None]:
    """The number of rows, and the keys of the slices to be split by position, or None.

    There are at most rows / ``hot_rows`` such keys, which bounds their broadcast.
    """
    counted = sliced.groupBy(*key).agg(F.count("*").alias("findings"))
    total, most = counted.agg(F.coalesce(F.sum("findings"), F.lit(0)), F.coalesce(F.max("findings"), F.lit(0))).head()
    if most <= hot_rows:
        return total, None
    hot = counted.filter(F.col("findings") > hot_rows).select(*key).checkpoint()
    # A finding that arrived before its predecessor in time: the neighbours are found by
    # position, chunk by chunk, with the last row of the chunk before as context.
    busy = sliced.join(F.broadcast(hot), key, "left_semi").select(*key, *_ORDER)
    numbered = in_chunks(global_positions(busy, [*key, *_ORDER], "position"), CHUNK_ROWS, 1)
    before = Window.partitionBy("chunk").orderBy("position")
    same = F.lit(True)
    for name in key:
        same &= F.lag(name).over(before).eqNullSafe(F.col(name))
    late = numbered.withColumn("late", same & (F.lag("arrival_seq").over(before) > F.col("arrival_seq")))
    orderly = hot.join(late.filter("late").select(*key).distinct(), key, "left_anti").checkpoint()
    return total, None if orderly.isEmpty() else orderly


def hot_groups(busy: DataFrame, rules: Sequence[CorrelationRule], length: int, key: list[str]) -> DataFrame:
    """Matches of orderly hot slices -> ``(rule_pos, members)`` in kernel form."""
    found = []
    closed = {pos: rules[pos].minimum_matches for pos in _with_closed_form(rules, length)}
    if closed:
        found.append(_by_count(busy.filter(F.col("rule_pos").isin(*closed)), closed, length, key))
    for pos in _with_chunks(rules, length):
        found.append(_by_chunks(busy.filter(F.col("rule_pos") == pos), pos, rules[pos], length, key))
    for pos, rule in enumerate(rules):
        if rule.enabled and rule.mode == "same_event":
            found.append(_first_of_rules(busy.filter(F.col("rule_pos") == pos), pos, rule, length, key))
    return reduce(DataFrame.unionByName, found)


def _with_probes(busy: DataFrame, length: int) -> DataFrame:
    """The findings and, for each trigger, a probe at the start of its look-back (``is_finding`` 0).

    A probe sorts before the findings of its own time: the look-back is closed.
    """
    probes = (
        busy.filter("own AND is_new")
        .withColumn("event_us", F.col("event_us") - length)
        .withColumn("is_finding", F.lit(0))
    )
    return busy.withColumn("is_finding", F.lit(1)).unionByName(probes)


def _order(key: list[str]) -> list[str]:
    return [*key, "event_us", "is_finding", *[name for name in _ORDER if name != "event_us"]]


def _located(busy: DataFrame, length: int, key: list[str]) -> DataFrame:
    """The findings with their ``position`` and, for triggers, that of the ``oldest`` in their look-back."""
    counted = global_running_count(_with_probes(busy, length), _order(key), "is_finding", "position")
    oldest = counted.filter("is_finding = 0").select(
        "rule_pos", "slice", "finding_uuid", F.col("position").alias("oldest")
    )
    return counted.filter("is_finding = 1").join(oldest, ["rule_pos", "slice", "finding_uuid"], "left")


def _windows(ends: DataFrame, steps: dict[int, int]) -> DataFrame:
    """The last rows up to each one marked in ``ends``, as members."""

    def emit(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("position").to_numpy(), kind="stable"))
        last = np.flatnonzero(table.column("ends").to_numpy() & table.column("own").to_numpy())
        positions = table.column("rule_pos").to_numpy()[last]
        parts = []
        for pos, size in steps.items():
            mine = last[positions == pos]
            rows = mine[:, None] + np.arange(-size + 1, 1)[None, :]
            parts.append(
                pa.table(
                    {
                        "rule_pos": pa.array(np.full(len(mine), pos, dtype=np.int32)),
                        "members": member_lists(table, rows),
                    }
                )
            )
        return pa.concat_tables(parts)

    chunked = in_chunks(ends, CHUNK_ROWS, max(steps.values()) - 1)
    return chunked.groupBy("chunk").applyInArrow(emit, f"rule_pos int, members array<{KERNEL_REF}>")


def _by_count(busy: DataFrame, steps: dict[int, int], length: int, key: list[str]) -> DataFrame:
    located = _located(busy, length, key)
    step = F.lit(0)
    for pos, size in steps.items():
        step = F.when(F.col("rule_pos") == pos, size).otherwise(step)
    seen = F.col("position") - F.col("oldest") + 1
    return _windows(located.withColumn("ends", F.coalesce((seen % step) == 0, F.lit(False))), steps)


def _by_chunks(busy: DataFrame, pos: int, rule: CorrelationRule, length: int, key: list[str]) -> DataFrame:
    step, window, size = rule.minimum_matches, rule.window_seconds * 1_000_000, max(CHUNK_ROWS, rule.minimum_matches - 1)
    located = _located(busy, length, key).checkpoint()
    narrow = in_chunks(located.select("position", "oldest", "event_us", *key), CHUNK_ROWS, step - 1)

    def summarise(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("position").to_numpy(), kind="stable"))
        own = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False))
        times, group, back = table.column("event_us").to_numpy(), codes(table, key), step - 1
        fits = np.zeros(table.num_rows, dtype=bool)
        if back < table.num_rows:
            first, last = slice(0, table.num_rows - back), slice(back, None)
            fits[last] = (times[last] - times[first] <= window) & (group[last] == group[first])
        count, following = len(own), next_true(fits[own])
        position = table.column("position").to_numpy()[own]
        oldest = table.column("oldest").fill_null(-1).to_numpy()[own]
        rows = np.arange(count)
        # The last window of a scan through each possible end, and what it leaves to the next chunk.
        after = following[np.minimum(rows + step, count)]
        final = np.where(after < count, after, rows)
        for _ in range(max(count, 1).bit_length()):
            final = final[final]
        begin = following[np.minimum(rows + step - 1, count)]
        leaves = np.where(begin < count, final[np.minimum(begin, max(count - 1, 0))] + step, rows + step - 1) - count
        chosen: list[list[int]] = [[] for _ in range(count)]
        exits = []
        for wait in range(step):
            ends, left = walk(following, wait, step)
            exits.append(left)
            for row in ends:
                chosen[row].append(wait)
        start = position[0] if count else 0
        here = np.flatnonzero(oldest >= start)
        local = np.zeros(count, dtype=bool)
        local[here] = reaches(following, begin[oldest[here] - start], here, step)
        return pa.table(
            {
                "chunk": pa.array(np.full(count + 1, table.column("chunk")[0].as_py())),
                "position": pa.array([*position, None], pa.int64()),
                "oldest": pa.array([*oldest, None], pa.int64()),
                "leaves": pa.array([*np.maximum(leaves, 0), None], pa.int64()),
                "entered": pa.array([*chosen, exits], pa.list_(pa.int64())),
                "hit": pa.array([*local, False]),
            }
        )

    schema = "chunk bigint, position bigint, oldest bigint, leaves bigint, entered array<bigint>, hit boolean"
    effects = narrow.groupBy("chunk").applyInArrow(summarise, schema).checkpoint()
    rows = effects.filter("position IS NOT NULL")
    starts = rows.select(F.col("position").alias("oldest"), F.col("chunk").alias("since"), "leaves")
    far = rows.filter(F.col("oldest").between(0, F.col("chunk") * size - 1)).drop("leaves").join(starts, "oldest")
    passed = _composed(effects.filter("position IS NULL"), far.select("since", "chunk").distinct())
    entry = F.get("passed", F.col("leaves").cast("int"))
    hit = far.join(passed, ["since", "chunk"]).filter(F.array_contains("entered", entry)).select("position")
    hits = rows.filter("hit").select("position").unionByName(hit).withColumn("ends", F.lit(True))
    ended = located.join(hits, "position", "left").withColumn("ends", F.coalesce("ends", F.lit(False)))
    return _windows(ended, {pos: step})


def _composed(tables: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs of chunks, what entering after the first with each number means for the second: since, chunk, passed.

    One row per chunk of rows, and about two pairs per chunk, so a single task composes them.
    """
    both = tables.select("chunk", F.lit(None).cast("bigint").alias("since"), "entered").unionByName(
        pairs.select("chunk", "since", F.lit(None).cast("array<bigint>").alias("entered"))
    )

    def compose(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_valid(table.column("entered"))).sort_by("chunk")
        wanted = table.filter(pc.is_valid(table.column("since")))
        level = np.array(known.column("entered").to_pylist(), dtype=np.int64).reshape(known.num_rows, -1)
        place = np.searchsorted(known.column("chunk").to_numpy(), wanted.column("since").to_numpy()) + 1
        left = np.searchsorted(known.column("chunk").to_numpy(), wanted.column("chunk").to_numpy()) - place
        passed, stride = np.tile(np.arange(level.shape[1]), (wanted.num_rows, 1)), 1
        while left.any():
            # ``level`` holds the effect of ``stride`` chunks from each one on.
            odd = np.flatnonzero(left & 1)
            passed[odd] = np.take_along_axis(level[place[odd]], passed[odd], axis=1)
            place[odd] += stride
            left >>= 1
            level = np.take_along_axis(level[stride:], level[:-stride], axis=1) if len(level) > stride else level[:0]
            stride *= 2
        return pa.table({"since": wanted.column("since"), "chunk": wanted.column("chunk"), "passed": pa.array(list(passed), pa.list_(pa.int64()))})

    return both.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(compose, "since bigint, chunk bigint, passed array<bigint>")


def _first_of_rules(busy: DataFrame, pos: int, rule: CorrelationRule, length: int, key: list[str]) -> DataFrame:
    """First finding of each required rule in a look-back, where one of them is the trigger."""
    required = rule.required_detection_rule_ids
    rows = _with_probes(busy, length)
    names = {name: f"of_{number}" for number, name in enumerate(dict.fromkeys(required))}
    for name in names:
        rows = rows.withColumn(f"is_{names[name]}", (F.col("is_finding") == 1) & (F.col("rule_id") == name))
    for name, count in names.items():
        rows = global_running_count(rows, _order(key), f"is_{count}", count)
    rows = rows.checkpoint()
    triggers = rows.filter("is_finding = 0").select(
        *key, *names.values(), "finding_uuid", F.col("rule_id").alias("trigger_rule"), (F.col("event_us") + length).alias("trigger_us"), F.col("arrival_seq").alias("trigger_seq")
    )
    ref = F.struct(*KERNEL_FIELDS)
    # Only triggers that are the first of their own rule can be in the selection.
    for name, count in names.items():
        firsts = rows.filter(f"is_{count}").select(*key, count, ref.alias(f"ref_{count}"))
        triggers = triggers.join(firsts, [*key, count])
        mine = F.col("trigger_rule") == name
        early = F.struct(F.col(f"ref_{count}.event_us"), F.col(f"ref_{count}.arrival_seq")) <= F.struct("trigger_us", "trigger_seq")
        triggers = triggers.filter(early & (~mine | (F.col(f"ref_{count}.finding_uuid") == F.col("finding_uuid"))))
    chosen = F.array(*[F.col(f"ref_{names[name]}") for name in required])
    times = F.transform("members", lambda m: m["event_us"])
    placed = F.transform("members", lambda m, i: F.struct(m["event_us"].alias("t"), i.alias("i"), m.alias("m")))
    span = F.array_max(times) - F.array_min(times)
    return (
        triggers.select(chosen.alias("members"))
        .filter((span <= rule.window_seconds * 1_000_000) & F.lit(len(required) >= rule.minimum_matches))
        .select(F.lit(pos).alias("rule_pos"), F.transform(F.array_sort(placed), lambda p: p["m"]).alias("members"))
        .distinct()
    )
