"""What a trigger sees when findings arrive out of order, for all triggers at once.

Findings stand in look-back order; a trigger sees those of its look-back that had arrived by
its own arrival. Two structures answer for many triggers in one go: a wavelet matrix over the
arrivals counts, or finds the k-th smallest arrival in, any stretch of rows; tables of minima
over doubling stretches find the next row that had arrived.

The greedy scan passes one number from row to row: how many of the next visible rows may not
end a window yet. A row can end one exactly from a certain arrival on, so a block of rows has
few different effects on that number, one for each arrival that matters in it. They are
tabulated once, and a trigger walks over whole blocks.
"""

from __future__ import annotations

import numpy as np

#: Look-backs up to this many rows are walked row by row.
SHORT = 256


class Arrivals:
    """Rows by rank of arrival; equal arrivals have equal ranks."""

    def __init__(self, arrival: np.ndarray) -> None:
        self.rank = np.unique(arrival, return_inverse=True)[1].reshape(-1)
        self.beyond = int(self.rank.max(initial=-1)) + 1
        self.zeros, values = [], self.rank
        for bit in reversed(range(max(self.beyond, 1).bit_length())):
            low = ((values >> bit) & 1) == 0
            self.zeros.append((bit, np.r_[0, np.cumsum(low)]))
            values = np.concatenate([values[low], values[~low]])

    def count(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Rows of [left, right) that arrived up to ``bound``."""
        below, found = bound + 1, np.zeros(len(left), dtype=np.int64)
        for bit, zeros in self.zeros:
            first, last = zeros[left], zeros[right]
            high = ((below >> bit) & 1) == 1
            found += np.where(high, last - first, 0)
            left = np.where(high, zeros[-1] + left - first, first)
            right = np.where(high, zeros[-1] + right - last, last)
        return found

    def smallest(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rank at ``place`` (from 0) among the sorted ranks of [left, right)."""
        found = np.zeros(len(left), dtype=np.int64)
        for bit, zeros in self.zeros:
            first, last = zeros[left], zeros[right]
            high = place >= last - first
            place = np.where(high, place - (last - first), place)
            found += np.where(high, 1 << bit, 0)
            left = np.where(high, zeros[-1] + left - first, first)
            right = np.where(high, zeros[-1] + right - last, last)
        return found


class Minima:
    """Tables of minima over stretches of doubling length."""

    def __init__(self, values: np.ndarray) -> None:
        self.tables = [values]
        while 2 << (len(self.tables) - 1) <= len(values):
            half = 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(self.tables[-1][:-half], self.tables[-1][half:]))

    def first(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from ``start`` on with a value up to ``bound``; the number of rows if there is none."""
        count, place = len(self.tables[0]), start.copy()
        for level in reversed(range(len(self.tables))):
            table = self.tables[level]
            inside = place + (1 << level) <= count
            above = inside & (table[np.where(inside, place, 0)] > bound) if len(table) else inside
            place = np.where(above, place + (1 << level), place)
        return place

    def last(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to ``start`` with a value up to ``bound``; -1 if there is none."""
        place = start.copy()
        for level in reversed(range(len(self.tables))):
            table, width = self.tables[level], 1 << level
            inside = place - width + 1 >= 0
            above = inside & (table[np.where(inside, place - width + 1, 0)] > bound) if len(table) else inside
            place = np.where(above, place - width, place)
        return place


def window_ends(arrivals: Arrivals, lowest: np.ndarray, step: int) -> np.ndarray:
    """From which arrival rank on each row can end a window of ``step`` rows that starts at ``lowest`` or later.

    The ``step - 1`` rows before it that arrived first decide; ``beyond`` where there are too few.
    """
    rows = np.arange(len(lowest))
    if step == 1:
        return arrivals.rank.copy()
    ends = np.full(len(rows), arrivals.beyond, dtype=np.int64)
    enough = np.flatnonzero(rows - lowest >= step - 1)
    needed = arrivals.smallest(lowest[enough], enough, np.full(len(enough), step - 2))
    ends[enough] = np.maximum(arrivals.rank[enough], needed)
    return ends


def greedy_hits(arrivals: Arrivals, ends: np.ndarray, step: int, start: np.ndarray, triggers: np.ndarray) -> np.ndarray:
    """Whether the greedy scan of each trigger, from ``start`` over what had arrived, ends a window at the trigger."""
    bound, wait = arrivals.rank[triggers], np.full(len(triggers), step - 1, dtype=np.int64)
    spans = triggers - start
    if spans.max(initial=0) <= SHORT:
        wait = _walk(arrivals.rank, ends, step, start, triggers, bound, wait)
        return (wait == 0) & (ends[triggers] <= bound)
    size = int(np.clip(np.sqrt(spans.max() / (2 * step)), 16, 512))
    head = -(-start // size)
    tail = np.maximum(triggers // size, head)
    wait = _walk(arrivals.rank, ends, step, start, np.minimum(head * size, triggers), bound, wait)
    spanned = np.flatnonzero(tail > head)
    if len(spanned):
        low, high = int(head[spanned].min()), int(tail[spanned].max())
        limits, effects = _effects(arrivals, ends, step, size, low, high)
        for block in range(low, high):
            here = spanned[(head[spanned] <= block) & (block < tail[spanned])]
            version = np.searchsorted(limits[block - low], bound[here], side="right")
            wait[here] = effects[block - low, version, wait[here]]
    wait = _walk(arrivals.rank, ends, step, np.minimum(np.maximum(tail * size, start), triggers), triggers, bound, wait)
    return (wait == 0) & (ends[triggers] <= bound)


def _walk(rank: np.ndarray, ends: np.ndarray, step: int, start: np.ndarray, stop: np.ndarray, bound: np.ndarray, wait: np.ndarray) -> np.ndarray:
    """The number after the rows [start, stop), row by row, all triggers side by side."""
    wait, length = wait.copy(), stop - start
    order = np.argsort(-length, kind="stable")
    left = np.searchsorted(-length[order], 0, side="left")
    for offset in range(int(length.max(initial=0))):
        left = int(np.searchsorted(-length[order[:left]], -offset, side="left"))
        here = order[:left]
        row, now, own = start[here] + offset, wait[here], bound[here]
        seen = rank[row] <= own
        done = (now == 0) & (ends[row] <= own)
        wait[here] = np.where(done, step - 1, np.where(seen & (now > 0), now - 1, now))
    return wait


def _effects(arrivals: Arrivals, ends: np.ndarray, step: int, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block: the arrival ranks at which its effect changes, and the effect between them by entry number."""
    rows, far = (high - low) * size, arrivals.beyond
    rank, end = np.full(rows, far, dtype=np.int64), np.full(rows, far, dtype=np.int64)
    known = min(len(ends), high * size) - low * size
    rank[:known], end[:known] = arrivals.rank[low * size : low * size + known], ends[low * size : low * size + known]
    rank, end = rank.reshape(-1, size), end.reshape(-1, size)
    limits = np.sort(np.concatenate([rank, end], axis=1), axis=1)
    bounds = np.concatenate([np.full((len(limits), 1), -1), limits], axis=1)
    effects = np.broadcast_to(np.arange(step), (*bounds.shape, step)).copy()
    for place in range(size):
        seen = (rank[:, place, None] <= bounds)[:, :, None]
        done = (end[:, place, None] <= bounds)[:, :, None] & (effects == 0)
        effects = np.where(done, step - 1, np.where(seen & (effects > 0), effects - 1, effects))
    return limits, effects
