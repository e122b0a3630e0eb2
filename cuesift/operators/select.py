"""Choosing the best frames of a truth curve: top-k, spaced top-k, peaks and spread.

Plain top-k is a window that Spark turns into a grouped limit. The others depend on the order of
choices and run on one timeline's arrays at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from cuesift.config import ChoiceRules


class Strategy(Protocol):
    """Chooses frames of a curve; returns indices in the order of choice and the phase of each."""

    def choose(self, curve: np.ndarray, k: int, fps: float = 1.0) -> tuple[list[int], list[str]]: ...


def by_score(curve: np.ndarray) -> np.ndarray:
    """Indices by score, the highest first; of equal scores the later frame first."""
    return np.lexsort((-np.arange(len(curve)), -curve))


class ScoreRanked:
    """The k highest frames; at least ``min_gap`` apart, at most ``max_per_window`` within ``window_seconds``."""

    def __init__(self, min_gap: int | None = None, max_per_window: int | None = None, window_seconds: float = 4.0):
        self.min_gap, self.max_per_window, self.window_seconds = min_gap, max_per_window, window_seconds

    @property
    def constrained(self) -> bool:
        return self.min_gap is not None or self.max_per_window is not None

    def choose(self, curve: np.ndarray, k: int, fps: float = 1.0) -> tuple[list[int], list[str]]:
        order = by_score(np.asarray(curve, float))
        if not self.constrained:
            chosen = order[:k].tolist()
            return chosen, ["score"] * len(chosen)
        chosen: list[int] = []
        near = [_Near(reach, most) for reach, most in ((self.min_gap, 1), (self.window_seconds * fps, self.max_per_window)) if reach is not None and most is not None]
        for i in order.tolist():
            if len(chosen) >= k:
                break
            if not any(x.full(i) for x in near):
                chosen.append(i)
                for x in near:
                    x.add(i)
        return chosen, ["score"] * len(chosen)


class _Near:
    """Chosen places in buckets as wide as the reach: only three of them can hold a place's neighbours."""

    def __init__(self, reach: float, most: int):
        self.reach, self.most, self.width = reach, most, max(1, math.ceil(reach))
        self.buckets: dict[int, list[int]] = {}

    def full(self, i: int) -> bool:
        """Whether ``most`` places closer than the reach are chosen."""
        b = i // self.width
        return sum(abs(j - i) < self.reach for x in (b - 1, b, b + 1) for j in self.buckets.get(x, ())) >= self.most

    def add(self, i: int) -> None:
        self.buckets.setdefault(i // self.width, []).append(i)


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict local maxima: a plateau counts at its middle, ends never."""
    if len(x) < 3:
        return np.zeros(0, int)
    starts = np.flatnonzero(np.diff(x, prepend=np.nan) != 0)  # runs of equal values
    ends = np.append(starts[1:], len(x)) - 1
    inner = (starts > 0) & (ends < len(x) - 1)
    s, e = starts[inner], ends[inner]
    high = (x[s - 1] < x[s]) & (x[e + 1] < x[e])
    return (s[high] + e[high]) // 2


def thinned(x: np.ndarray, peaks: np.ndarray, distance: float) -> np.ndarray:
    """Peaks at least ``distance`` apart: the highest first (of equals the later), those too near to one that is kept go."""
    gap = math.ceil(distance)
    keep, gone = np.zeros(len(peaks), bool), np.zeros(len(peaks), bool)
    first = np.searchsorted(peaks, peaks - gap, "right").tolist()
    last = np.searchsorted(peaks, peaks + gap).tolist()
    for i in np.argsort(x[peaks], kind="stable")[::-1].tolist():
        if not gone[i]:
            keep[i] = True
            gone[first[i] : last[i]] = True  # kept peaks are a gap apart, so a peak goes twice at most
    return peaks[keep]


def _lows(heights: list[float], valleys: list[float]) -> list[float]:
    """For each maximum the lowest point to its left before a higher one: a stack of falling heights."""
    tops: list[tuple[float, float]] = []
    out = []
    for h, low in zip(heights, valleys, strict=True):
        while tops and tops[-1][0] <= h:
            low = min(low, tops.pop()[1])
        tops.append((h, low))
        out.append(low)
    return out


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """How far each of the local maxima ``peaks`` stands above the higher of the lowest points that part it from higher ground on either side.

    Between neighbouring maxima a curve falls, then rises: the maxima, both ends and the lowest point between each two say everything.
    """
    if not len(peaks):
        return np.zeros(0)
    at = np.unique(np.concatenate([[0], local_maxima(x), [len(x) - 1]]))
    low = np.minimum(np.minimum.reduceat(x, at)[:-1], x[at[1:]])  # from each up to and with the next
    h = x[at]
    left = _lows(h.tolist(), [float(h[0]), *low.tolist()])
    right = _lows(h[::-1].tolist(), [float(h[-1]), *low[::-1].tolist()])[::-1]
    own = np.searchsorted(at, peaks)
    return x[peaks] - np.minimum(x[peaks], np.maximum(np.array(left)[own], np.array(right)[own]))


def find_peaks(x: np.ndarray, distance: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Local maxima, thinned by distance, then by prominence; in time n log n."""
    x = np.asarray(x, float)
    peaks = local_maxima(x)
    if distance is not None and len(peaks):
        peaks = thinned(x, peaks, distance)
    if prominence is not None and len(peaks):
        peaks = peaks[prominences(x, peaks) >= prominence]
    return peaks


class PeaksAndSpread:
    """Peaks first, then good neighbours of each, then what scores best of the rest.

    With k frames: up to int(sqrt k) peaks, the prominence threshold being halved until there is one, max(0, int(sqrt k / 2) - 1) extra
    frames around each. Fewer than 8 frames are plain top-k.
    """

    SMALL, TRIES = 8, 5

    def __init__(self, prominence_ratio: float = 0.01, min_prominence: float = 1e-6):
        self.prominence_ratio, self.min_prominence = prominence_ratio, min_prominence

    def choose(self, curve: np.ndarray, k: int, fps: float = 1.0) -> tuple[list[int], list[str]]:
        x = np.asarray(curve, float)
        k = min(k, len(x))
        if k < self.SMALL:
            return ScoreRanked().choose(x, k, fps)
        root = math.sqrt(k)
        want, extra = int(root), max(0, int(root / 2) - 1)
        distance, half = max(1, int(root * fps)), max(1, int(root / 2 * fps))
        need = max(self.min_prominence, self.prominence_ratio * (x.max() - x.min()))
        apart = find_peaks(x, distance)
        height, peaks = prominences(x, apart), np.zeros(0, int)
        for _ in range(self.TRIES):
            peaks = apart[height >= need]
            if len(peaks):
                break
            need /= 2
        chosen: dict[int, str] = {}
        ranked = peaks[by_score(x[peaks])] if len(peaks) else by_score(x)
        for p in ranked[:want].tolist():
            chosen[p] = "peak"
        for p in list(chosen):
            near = [i for i in range(max(0, p - half), min(len(x), p + half + 1)) if i not in chosen]
            for i in sorted(near, key=lambda i: -x[i])[:extra]:  # stable: of equals the earlier
                if len(chosen) < k:
                    chosen[i] = "spread"
        for i in by_score(x).tolist():
            if len(chosen) >= k:
                break
            chosen.setdefault(i, "fill")
        return list(chosen)[:k], list(chosen.values())[:k]


def create_strategy(config: ChoiceRules | None = None, **options) -> Strategy:
    config = config or ChoiceRules(**options)
    if config.mode == "pass":
        return PeaksAndSpread(config.prominence)
    if config.mode == "score_ranked":
        return ScoreRanked(config.gap, config.per_window, config.window)
    if config.mode in _STRATEGIES:
        return _STRATEGIES[config.mode](config)
    raise ValueError(f"unknown selection mode {config.mode!r}")


_STRATEGIES: dict = {}


def register_strategy(name: str, make) -> None:
    """``make(ChoiceRules) -> Strategy``"""
    _STRATEGIES[name] = make


def top_k(truth: DataFrame, k: int, keys: Sequence[str] = ("video_id", "qid"), order: str = "frame_idx") -> DataFrame:
    """The k highest frames of each timeline with their rank; of equal scores the later frame first."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(order).desc())
    return truth.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def select(truth: DataFrame, k: int, strategy: Strategy, fps: float = 1.0, keys: Sequence[str] = ("video_id", "qid")) -> DataFrame:
    """(keys, frame_idx, score) -> (keys, rank, frame_idx, score, phase), ranks from 1 in the order of choice."""
    if isinstance(strategy, ScoreRanked) and not strategy.constrained:
        return top_k(truth.select(*keys, "frame_idx", "score"), k, keys).select(*keys, "rank", "frame_idx", "score", F.lit("score").alias("phase"))
    fields = [truth.schema[c] for c in keys]
    schema = StructType([*fields, StructField("rank", IntegerType()), StructField("frame_idx", truth.schema["frame_idx"].dataType), StructField("score", DoubleType()), StructField("phase", StringType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx", ignore_index=True)
        # a curve is rounded so that frames that differ by the last bits tie
        at, phase = strategy.choose(rows["score"].round(12).to_numpy(), k, fps)
        out = rows.iloc[at][[*keys, "frame_idx", "score"]].reset_index(drop=True)
        return out.assign(rank=np.arange(1, len(at) + 1), phase=np.array(phase, object))[[*keys, "rank", "frame_idx", "score", "phase"]]

    return truth.select(*keys, "frame_idx", F.col("score").cast("double").alias("score")).groupBy(*keys).applyInPandas(run, schema)
