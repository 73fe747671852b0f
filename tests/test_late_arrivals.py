"""Look-backs with late arrivals: the kernels against a row-by-row simulation."""

from __future__ import annotations

import time

import numpy as np
import pytest

from hostwarden.operators import late_arrivals
from hostwarden.operators.anchored import _View


def view(group, times, arrival, length):
    order = np.lexsort((arrival, times, group))
    group = np.unique(group[order], return_inverse=True)[1]
    return _View(group, times[order].astype(np.int64), arrival[order].astype(np.int64), np.zeros(len(times), int), ["r"], length)


def simulated(rows, step, window):
    """Greedy windows that end at their trigger, each trigger on what it sees."""
    out = []
    for trigger in range(len(rows.times)):
        current, hit = [], None
        for row in range(rows.oldest[trigger], trigger + 1):
            if rows.arrival[row] <= rows.arrival[trigger]:
                current = [r for r in current if rows.times[row] - rows.times[r] <= window] + [row]
                if len(current) >= step:
                    hit, current = tuple(current), []
        if hit is not None and hit[-1] == trigger:
            out.append(hit)
    return sorted(out)


@pytest.mark.parametrize("short", [0, 7, 256])
def test_windows_equal_simulation(monkeypatch, short):
    monkeypatch.setattr(late_arrivals, "SHORT", short)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        count, step, window = int(rng.integers(1, 150)), int(rng.integers(1, 5)), int(rng.choice([10, 30, 100]))
        arrival = rng.integers(0, count, count) if seed % 2 else rng.permutation(count)
        rows = view(rng.integers(0, 3, count), rng.integers(0, 200, count), arrival, 100)
        found = rows._late_windows(np.arange(count), step, window)
        assert sorted(map(tuple, found.tolist())) == simulated(rows, step, window)


def test_counts_and_next_rows():
    rng = np.random.default_rng(1)
    for count in (0, 1, 2, 37):
        arrivals = late_arrivals.Arrivals(rng.integers(0, 9, count))
        rank, minima = arrivals.rank, late_arrivals.Minima(arrivals.rank)
        left = rng.integers(0, count + 1, 50)
        right = left + rng.integers(0, count + 1, 50) % (count - left + 1)
        bound = rng.integers(0, 9, 50)
        expected = [(rank[a:b] <= c).sum() for a, b, c in zip(left, right, bound)]
        assert arrivals.count(left, right, np.minimum(bound, arrivals.beyond - 1)).tolist() == expected
        assert minima.first(left, bound).tolist() == [next((p for p in range(a, count) if rank[p] <= c), count) for a, c in zip(left, bound)]
        assert minima.last(left - 1, bound).tolist() == [next((p for p in reversed(range(a)) if rank[p] <= c), -1) for a, c in zip(left, bound)]
        for a, b in zip(left, right):
            places = np.arange(b - a)
            assert arrivals.smallest(np.full(b - a, a), np.full(b - a, b), places).tolist() == sorted(rank[a:b])


def test_one_slice_in_any_order_is_not_quadratic():
    """Four times the rows of one look-back take far less than sixteen times as long."""
    seconds = []
    for count in (10_000, 40_000):
        rng = np.random.default_rng(0)
        rows = view(np.zeros(count, int), np.sort(rng.integers(0, 600_000_000, count)), rng.permutation(count), 600_000_000)
        start = time.process_time()
        found = rows._late_windows(np.arange(count), 3, 60_000_000)
        seconds.append(time.process_time() - start)
        assert len(found) > count // 5
    assert seconds[1] < 13 * seconds[0] + 1
