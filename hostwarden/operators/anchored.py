"""Correlation anchored at each new finding, as a live system computes it.

Every new finding looks back over the findings of its host that had arrived by
then and are at most the longest rule window older, runs the rule on those, and
keeps the match that contains itself. Temporal rules restart their greedy scan at
the oldest finding of each look-back, so the result differs from a scan over the
full history.

The look-back bounds what a finding can see. So the history is cut into slices
of that length, every finding goes to its own slice and, as context, to the next
one, and the slices of all rules and groups are spread over many cells. One cell
is one vectorised pass; a busy host fills as many cells as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hostwarden.operators.correlate import (
    CorrelationRule,
    look_back_seconds,
    refs,
    required_rule_ids,
)
from hostwarden.operators.hot_slices import hot_groups, hot_slices
from hostwarden.operators.late_arrivals import Arrivals, Minima, greedy_hits, window_ends
from hostwarden.operators.temporal import (
    KERNEL_REF,
    codes,
    from_kernel,
    member_lists,
    next_true,
    reaches,
    to_kernel,
)

CELLS_PER_SHUFFLE_PARTITION = 4
# Findings of a cell on average, at most.
CELL_ROWS = 500_000
# Findings of one slice of one group that one cell may still take.
HOT_ROWS = 2_000_000


def anchored_groups(
    findings: DataFrame,
    rules: Sequence[CorrelationRule],
    history: DataFrame | None = None,
    cells: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """New findings, and stored ones as ``history`` -> ``(rule_pos, members)``.

    All rules share one shuffle of the narrow refs. A slice of a group with more
    than ``hot_rows`` findings is too big for one cell; it is split by position
    instead, unless some of its findings arrived out of order.
    """
    schema = f"rule_pos int, members array<{KERNEL_REF}>"
    length = look_back_seconds(rules) * 1_000_000
    if not any(rule.enabled for rule in rules):
        return from_kernel(findings.sparkSession.createDataFrame([], schema))
    seen = refs(findings).withColumn("is_new", F.lit(True))
    if history is not None:
        seen = seen.unionByName(refs(history).withColumn("is_new", F.lit(False)))
    sliced = _sliced(per_rule(seen, rules), length)

    def kernel(table: pa.Table) -> pa.Table:
        positions = table.column("rule_pos")
        found = [
            matches_of_rule(table.filter(pc.equal(positions, pos)), pos, rule, length)
            for pos, rule in enumerate(rules)
            if rule.enabled
        ]
        return pa.concat_tables(found)

    key = ["rule_pos", "source_host", "group_key", "slice"]
    total, hot = hot_slices(sliced, key, hot_rows)
    cells = cells or max(_usual_cells(sliced), -(-total // CELL_ROWS))
    if hot is None:
        return from_kernel(_by_cell(sliced, key, cells).applyInArrow(kernel, schema))
    usual = sliced.join(F.broadcast(hot), key, "left_anti")
    busy = sliced.join(F.broadcast(hot), key, "left_semi")
    regular = _by_cell(usual, key, cells).applyInArrow(kernel, schema)
    return from_kernel(regular.unionByName(hot_groups(busy, rules, length, key)))


def per_rule(seen: DataFrame, rules: Sequence[CorrelationRule]) -> DataFrame:
    """One row per finding and enabled rule that needs it, with the rule's grouping values."""
    rows, group_key = [], F.lit(None).cast("string")
    for pos, rule in enumerate(rules):
        if rule.enabled:
            needed = F.col("rule_id").isin(*rule.required_detection_rule_ids)
            for field in rule.group_by:
                needed &= F.col(field).isNotNull()
            rows.append(F.when(needed, F.lit(pos)))
            values = F.to_json(F.array(*[F.col(field).cast("string") for field in rule.group_by]))
            group_key = F.when(F.col("rule_pos") == pos, values).otherwise(group_key)
    known = to_kernel(seen.filter(F.col("rule_id").isin(*required_rule_ids(rules))))
    return (
        known.withColumn("rule_pos", F.explode(F.array(*rows)))
        .filter(F.col("rule_pos").isNotNull())
        .withColumn("group_key", group_key)
    )


def candidate_counts(
    findings: DataFrame, rules: Sequence[CorrelationRule], cells: int | None = None
) -> DataFrame:
    """How many findings each finding can look back on, itself included: ``finding_uuid, candidates``."""
    length = look_back_seconds(rules) * 1_000_000
    needed = sorted(required_rule_ids(rules))

    def kernel(table: pa.Table) -> pa.Table:
        table, view = _ordered_view(table, [], needed, length)
        own = np.flatnonzero(table.column("own").to_numpy())
        late = view.late(own)
        counts = view.event_end[own] - view.oldest[own] + 1
        if late.any():
            rows, arrivals = own[late], view.arrivals
            counts[late] = arrivals.count(view.oldest[rows], view.event_end[rows] + 1, arrivals.rank[rows])
        return pa.table({"finding_uuid": table.column("finding_uuid").take(own), "candidates": counts})

    known = to_kernel(refs(findings).filter(F.col("rule_id").isin(*needed)))
    grouped = _by_cell(_sliced(known, length), ["source_host", "slice"], cells)
    return grouped.applyInArrow(kernel, "finding_uuid string, candidates bigint")


def _sliced(rows: DataFrame, length: int) -> DataFrame:
    """Every finding in its own slice of the history and, as context, in the next one."""
    home = F.expr(f"(event_us - pmod(event_us, {length}L)) div {length}L")
    return rows.withColumn("slice", F.explode(F.array(home, home + 1))).withColumn(
        "own", F.col("slice") == home
    )


def _usual_cells(rows: DataFrame) -> int:
    return CELLS_PER_SHUFFLE_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_cell(rows: DataFrame, key: list[str], cells: int | None):
    cells = cells or _usual_cells(rows)
    return rows.withColumn("cell", F.pmod(F.xxhash64(*key), F.lit(cells))).groupBy("cell")


def _ordered_view(
    table: pa.Table, group_by: list[str], names: list[str], length: int
) -> tuple[pa.Table, "_View"]:
    """Findings of the named rules in look-back order, those without a group left out."""
    number = pc.index_in(table.column("rule_id"), value_set=pa.array(names))
    keep = pc.is_valid(number)
    for field in group_by:
        keep = pc.and_(keep, pc.is_valid(table.column(field)))
    table, number = table.filter(keep), number.filter(keep).to_numpy()
    group = codes(table, ["source_host", "slice", *group_by])
    version = table.column("rule_version").to_numpy()
    arrival, times = table.column("arrival_seq").to_numpy(), table.column("event_us").to_numpy()
    order = np.lexsort((version, number, arrival, times, group))
    view = _View(group[order], times[order], arrival[order], number[order], names, length)
    return table.take(order), view


def matches_of_rule(table: pa.Table, rule_pos: int, rule: CorrelationRule, length: int) -> pa.Table:
    names = sorted(set(rule.required_detection_rule_ids))
    table, view = _ordered_view(table, list(rule.group_by), names, length)
    fresh = pc.and_(table.column("own"), table.column("is_new"))
    triggers = np.flatnonzero(fresh.to_numpy())
    if rule.mode == "temporal_count":
        rows = view.windows(triggers, rule)
    else:
        rows = view.selections(triggers, rule)
    return pa.table(
        {
            "rule_pos": pa.array(np.full(len(rows), rule_pos, dtype=np.int32)),
            "members": member_lists(table, rows),
        }
    )


class _View:
    """Findings ordered by group, event time and arrival, with the look-back of each row."""

    def __init__(self, group, times, arrival, rule, names, length):
        self.group, self.times, self.arrival, self.rule = group, times, arrival, rule
        self.names = names
        count = len(times)
        self.oldest = self.key = np.zeros(count, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if count else np.array([], int)
        self.group_start = starts[group] if count else starts
        if count:
            # Within a group all times lie in two slices, so group and time fit one sort key.
            relative = times - (times // length) * length
            relative += (times // length - np.minimum.reduceat(times // length, starts)[group]) * length
            self.key = group * (4 * length) + relative + length
            self.oldest = self.rows_since(length)

        # Rows of one event share time and arrival; where the run of such rows ends.
        changes = (group[1:] != group[:-1]) | (times[1:] != times[:-1]) | (arrival[1:] != arrival[:-1])
        self.event_end = next_true(np.r_[changes, True][:count])[:-1]

    def late(self, triggers: np.ndarray) -> np.ndarray:
        """Triggers that have a finding in their look-back which arrived after them."""
        late = np.zeros(len(triggers), dtype=bool)
        in_order = (self.arrival[1:] >= self.arrival[:-1]) | (self.group[1:] != self.group[:-1])
        if not len(triggers) or in_order.all():
            return late
        # Highest arrival in [oldest, trigger) from maxima over blocks of doubling length.
        spans = triggers - self.oldest[triggers]
        best, width = self.arrival, 1
        while width <= spans.max():
            rows = np.flatnonzero((spans >= width) & (spans < 2 * width))
            left, right = self.oldest[triggers[rows]], triggers[rows] - width
            late[rows] = np.maximum(best[left], best[right]) > self.arrival[triggers[rows]]
            best = np.maximum(best[:-width], best[width:]) if len(best) > width else best
            width *= 2
        return late

    def rows_since(self, length: int) -> np.ndarray:
        """For every row, the first row of its group that is at most ``length`` older."""
        return np.maximum(np.searchsorted(self.key, self.key - length, side="left"), self.group_start)

    @cached_property
    def arrivals(self) -> Arrivals:
        return Arrivals(self.arrival)

    def _late_windows(self, triggers: np.ndarray, step: int, window: int) -> np.ndarray:
        """Rows of the greedy windows that end at triggers with late arrivals in their look-back."""
        arrivals = self.arrivals
        ends = window_ends(arrivals, self.rows_since(window), step)
        hit = triggers[greedy_hits(arrivals, ends, step, self.oldest[triggers], triggers)]
        rows, minima = [hit], Minima(arrivals.rank)
        for _ in range(step - 1):
            rows.append(minima.last(rows[-1] - 1, arrivals.rank[hit]))
        return np.stack(rows[::-1], axis=1)

    def windows(self, triggers: np.ndarray, rule: CorrelationRule) -> np.ndarray:
        """Rows of the greedy windows that end at a trigger."""
        step, window = rule.minimum_matches, rule.window_seconds * 1_000_000
        count = len(self.times)
        late = self.late(triggers)
        plain = triggers[~late]
        ends = np.zeros(count, dtype=bool)
        if step <= count:
            first, last = slice(0, count - step + 1), slice(step - 1, None)
            ends[last] = (self.times[last] - self.times[first] <= window) & (
                self.group[last] == self.group[first]
            )
        following = next_true(ends)
        plain = plain[ends[plain]]
        first = following[np.minimum(self.oldest[plain] + step - 1, count)]
        hit = plain[reaches(following, first, plain, step)]
        found = [hit[:, None] + np.arange(-step + 1, 1)[None, :]]
        if late.any():
            found.append(self._late_windows(triggers[late], step, window))
        return np.concatenate(found).astype(np.int64)

    def selections(self, triggers: np.ndarray, rule: CorrelationRule) -> np.ndarray:
        """Rows of same-event selections (first finding per required rule) holding a trigger."""
        required = rule.required_detection_rule_ids
        numbers = [self.names.index(name) for name in required]
        if len(required) < rule.minimum_matches or not len(triggers):
            return np.empty((0, len(required)), dtype=np.int64)
        count, late = len(self.times), self.late(triggers)
        plain = triggers[~late]
        # Rows of one event share time and arrival and are stored together before any
        # of them triggers, so a trigger sees up to the last row of its event.
        event_end = self.event_end
        picks = np.empty((len(plain), len(required)), dtype=np.int64)
        valid = np.ones(len(plain), dtype=bool)
        for column, number in enumerate(numbers):
            rows = np.append(np.flatnonzero(self.rule == number), count)
            picks[:, column] = rows[np.searchsorted(rows, self.oldest[plain])]
            valid &= picks[:, column] <= event_end[plain]
        found = [picks[valid & (picks == plain[:, None]).any(axis=1)]]
        if late.any():
            rows, arrivals = triggers[late], self.arrivals
            firsts = [
                Minima(np.where(self.rule == number, arrivals.rank, arrivals.beyond)).first(self.oldest[rows], arrivals.rank[rows])
                for number in numbers
            ]
            picks = np.stack(firsts, axis=1)
            valid = (picks <= event_end[rows][:, None]).all(axis=1) & (picks == rows[:, None]).any(axis=1)
            found.append(picks[valid])
        # Two findings of one event can trigger the same selection.
        chosen = np.unique(np.concatenate(found).astype(np.int64), axis=0)
        times = self.times[chosen]
        chosen = chosen[times.max(axis=1) - times.min(axis=1) <= rule.window_seconds * 1_000_000]
        by_time = np.argsort(self.times[chosen], axis=1, kind="stable")
        return np.take_along_axis(chosen, by_time, axis=1)
