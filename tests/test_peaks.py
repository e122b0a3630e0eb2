from __future__ import annotations

import math
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cuesift.operators.select import PeaksAndSpread, ScoreRanked, by_score, find_peaks, prominences


def scanned_prominence(x, p):
    lows = []
    for side in (x[:p][::-1], x[p + 1 :]):
        above = [i for i, v in enumerate(side) if v > x[p]]
        reach = side[: above[0]] if above else side
        lows.append(min([x[p], *reach]))
    return x[p] - max(lows)


def scanned_peaks(x, distance, prominence):
    runs, i = [], 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if i > 0 and j < len(x) - 1 and x[i - 1] < x[i] > x[j + 1]:
            runs.append((i + j) // 2)
        i = j + 1
    left = sorted(runs, key=lambda p: (x[p], p), reverse=True)
    kept = []
    for p in left:
        if distance is None or all(abs(p - q) >= math.ceil(distance) for q in kept):
            kept.append(p)
    return sorted(p for p in kept if prominence is None or scanned_prominence(x, p) >= prominence)


curves = st.lists(st.integers(0, 6), min_size=1, max_size=60).map(lambda v: [x / 4 for x in v])


@settings(max_examples=400, deadline=None)
@given(curves, st.sampled_from([None, 1, 2, 3.5, 9]), st.sampled_from([None, 1e-6, 0.25, 0.6, 1.0]))
def test_peaks_are_those_of_a_scan(curve, distance, prominence):
    assert find_peaks(np.array(curve), distance, prominence).tolist() == scanned_peaks(curve, distance, prominence)


@settings(max_examples=200, deadline=None)
@given(curves, st.integers(0, 12), st.sampled_from([None, 0, 1, 2, 5]), st.sampled_from([None, 1, 2]), st.sampled_from([0.5, 2.0, 4.0]), st.sampled_from([0.5, 1.0, 3.0]))
def test_spaced_choices_are_those_of_all_pairs(curve, k, gap, most, window, fps):
    chosen = []
    for i in by_score(np.array(curve)).tolist():
        near = [abs(i - j) for j in chosen]
        if len(chosen) < k and not (gap is not None and any(d < gap for d in near)) and not (most is not None and sum(d < window * fps for d in near) >= most):
            chosen.append(i)
    assert ScoreRanked(gap, most, window).choose(np.array(curve), k, fps)[0] == chosen


def test_a_million_frames():
    rng = np.random.default_rng(1)
    for x in (rng.random(1_000_000), np.cumsum(rng.standard_normal(1_000_000)), np.round(rng.random(1_000_000), 1)):
        start = time.perf_counter()
        PeaksAndSpread().choose(x, 400)
        ScoreRanked(50, 3, 100.0).choose(x, 400)
        assert time.perf_counter() - start < 12  # some two seconds on a machine of its own
    peaks = find_peaks(x[:3000])
    assert np.allclose(prominences(x[:3000], peaks), [scanned_prominence(x[:3000].tolist(), p) for p in peaks.tolist()])
