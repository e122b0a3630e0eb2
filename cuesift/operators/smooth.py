"""Gaussian smoothing of signals with a width that fits the modality."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesift.config import EXPERTS, SignalRules

#: Widest kernel half that is written as lags; beyond it signals are gathered as arrays.
MOST_LAGS = 24


def kernel(sigma: float) -> list[float]:
    """Weights from -R to R, R = int(4 sigma + 0.5), with sum 1; sigma in frames."""
    if sigma <= 0:
        return [1.0]
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(df: DataFrame, sigma: float, by: Sequence[str], score: str = "score", out: str = "score", order: str = "frame_idx") -> DataFrame:
    """Convolve each signal with a Gaussian of ``sigma`` frames; beyond the ends the end values go on."""
    w = kernel(sigma)
    return _convolve(df, [(None, w)], by, score, out, order) if len(w) > 1 else df.withColumn(out, F.col(score))


def smooth_by_expert(df: DataFrame, config: SignalRules, fps: float, by: Sequence[str], score: str = "score", out: str = "score", order: str = "frame_idx") -> DataFrame:
    """As ``smooth``, each row's width chosen by its expert, in one pass over all signals."""
    if not config.widths:
        return df.withColumn(out, F.col(score))
    return _convolve(df, [(e, kernel(config.width_of(e) * fps)) for e in EXPERTS] + [(None, kernel(config.width("visual") * fps))], by, score, out, order)


def _weight(kernels: list[tuple[str | None, list[float]]], k: int) -> Column:
    """The weight at offset k: that of the row's expert, of the entry without one otherwise."""
    at = lambda w: w[k + len(w) // 2] if abs(k) <= len(w) // 2 else 0.0
    values = {e: at(w) for e, w in kernels}
    if len(set(values.values())) == 1:
        return F.lit(values[None])
    out = None
    for e, v in values.items():
        if e is not None:
            out = F.when(F.col("expert") == e, F.lit(v)) if out is None else out.when(F.col("expert") == e, F.lit(v))
    return out.otherwise(F.lit(values[None]))


def _convolve(df, kernels, by, score, out, order) -> DataFrame:
    r = max(len(w) for _, w in kernels) // 2
    if r > MOST_LAGS:
        return _convolve_arrays(df, kernels, r, by, score, out, order)
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.col(score)
    df = df.withColumn("_first", F.first(x).over(w)).withColumn("_last", F.last(x).over(whole))
    df = df.select("*", *[F.coalesce((F.lag(x, k) if k > 0 else F.lead(x, -k)).over(w), F.col("_first" if k > 0 else "_last")).alias(f"_x{k}") for k in range(-r, r + 1) if k])
    total = None
    for k in range(-r, r + 1):
        term = (F.col(f"_x{k}") if k else x) * _weight(kernels, k)
        total = term if total is None else total + term
    extra = ["_first", "_last", *[f"_x{k}" for k in range(-r, r + 1) if k]]
    return df.withColumn("_y", total).drop(*extra).withColumn(out, F.col("_y")).drop("_y")


def _convolve_arrays(df, kernels, r, by, score, out, order) -> DataFrame:
    """For wide kernels: a signal as one array on each row's partition, indexed with clamping."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_all", F.collect_list(score).over(whole)).withColumn("_i", F.row_number().over(w) - 1)
    weights = F.array(*[_weight(kernels, k) for k in range(-r, r + 1)])
    at = lambda k: F.get("_all", F.least(F.greatest(F.col("_i") - (k - r), F.lit(0)), F.size("_all") - 1))
    total = F.aggregate(F.transform(weights, lambda v, k: v * at(k)), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn(out, total).drop("_all", "_i")
