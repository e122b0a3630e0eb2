"""Fuzzy and temporal operators as columns over one timeline.

``w`` is Window.partitionBy(timeline).orderBy(frame); operands are columns with values of 0 to 1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

AND_MODES = ("product", "min", "geometric_mean")
#: Beyond exp(-CUT) an earlier cause adds nothing that a double keeps.
CUT = 40.0
#: Most offsets of the decay that are written as lags; beyond it a timeline's sums are made in one go.
MOST_LAGS = 64


def fuzzy_and(operands: Sequence[Column], mode: str = "product") -> Column:
    if mode not in AND_MODES:
        raise ValueError(f"unknown AND mode {mode!r}; one of {AND_MODES}")
    if len(operands) == 1:
        return operands[0]
    if mode == "min":
        return F.least(*operands)
    product = reduce(lambda a, b: a * b, operands)
    return product if mode == "product" else F.pow(product, F.lit(1 / len(operands)))


def fuzzy_or(operands: Sequence[Column]) -> Column:
    """Probabilistic sum a + b - a b, folded from the left."""
    return reduce(lambda a, b: a + b - a * b, operands)


def before_max(x: Column, keys: Sequence[str], order: str) -> Column:
    """The greatest value of earlier frames, 0 at the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(x).over(w), F.lit(0.0))


def after_max(x: Column, keys: Sequence[str], order: str) -> Column:
    """The greatest value of later frames, 0 at the last; a running maximum in reverse order."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(x).over(w), F.lit(0.0))


def seq(df: DataFrame, operands: Sequence[str], keys: Sequence[str], out: str, order: str = "frame_idx") -> DataFrame:
    """``out``: being at one step of a sequence, with all steps before it in the past and all after it to come."""
    if len(operands) < 2:
        raise ValueError("SEQ needs two children or more")
    gates = [before_max(F.col(c), keys, order).alias(f"_h{i}") for i, c in enumerate(operands[:-1])]
    gates += [after_max(F.col(c), keys, order).alias(f"_f{i}") for i, c in enumerate(operands) if i]
    df = df.select("*", *gates)
    steps = []
    for i, c in enumerate(operands):
        past = [F.col(f"_h{j}") for j in range(i)]
        future = [F.col(f"_f{j}") for j in range(i + 1, len(operands))]
        steps.append(reduce(lambda a, b: a * b, [F.col(c), *past, *future]))
    extra = [c for c in df.columns if c.startswith(("_h", "_f")) and c[2:].isdigit()]
    return df.withColumn("_y", F.greatest(*steps, F.lit(0.0))).drop(*extra).withColumnRenamed("_y", out)


def right_after(df: DataFrame, cause: str, effect: str, keys: Sequence[str], out: str, kappa: float = 2.0, fps: float = 1.0, order: str = "frame_idx") -> DataFrame:
    """``out``: an effect with causes shortly before, or a cause with effects shortly after, whichever is more.

    Each side is a value times the sum of the other's earlier (later) values, decayed by exp(-kappa seconds).
    """
    rate = kappa / fps
    reach = math.ceil(CUT / rate)
    if reach > MOST_LAGS:
        return _right_after_fold(df, cause, effect, keys, out, rate, order)
    w = Window.partitionBy(*keys).orderBy(order)
    both = [F.coalesce(F.lag(cause, d).over(w), F.lit(0.0)).alias(f"_c{d}") for d in range(1, reach + 1)]
    both += [F.coalesce(F.lead(effect, d).over(w), F.lit(0.0)).alias(f"_e{d}") for d in range(1, reach + 1)]
    wide = df.select("*", *both)
    total = lambda p: reduce(lambda a, b: a + b, [F.col(f"{p}{d}") * math.exp(-rate * d) for d in range(1, reach + 1)])
    y = F.greatest(F.col(effect) * total("_c"), F.col(cause) * total("_e"))
    return wide.withColumn("_y", y).drop(*[f"_{p}{d}" for p in "ce" for d in range(1, reach + 1)]).withColumnRenamed("_y", out)


def faded(x: np.ndarray, rate: float) -> np.ndarray:
    """h(t) = sum over s < t of x(s) exp(-rate (t - s)): running sums over blocks whose weights stay finite."""
    out, h = np.empty(len(x)), 0.0
    block = max(1, int(500 / rate))
    for a in range(0, len(x), block):
        part = x[a : a + block]
        k = np.arange(len(part))
        total = h + np.concatenate([[0.0], np.cumsum(part * np.exp(rate * k))])
        out[a : a + len(part)] = total[:-1] * np.exp(-rate * k)
        h = total[-1] * np.exp(-rate * len(part))
    return out


def _right_after_fold(df, cause, effect, keys, out, rate, order) -> DataFrame:
    """For slow decay: the sums of a whole timeline at once, in time proportional to its frames."""
    rows = df.select(*keys, order, F.col(cause).cast("double").alias("_c"), F.col(effect).cast("double").alias("_e"))
    schema = StructType([*(df.schema[c] for c in keys), df.schema[order], StructField(out, DoubleType())])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order, ignore_index=True)
        c, e = t["_c"].to_numpy(), t["_e"].to_numpy()
        y = np.maximum(e * faded(c, rate), c * faded(e[::-1], rate)[::-1])
        return t[[*keys, order]].assign(**{out: y})

    return df.join(rows.groupBy(*keys).applyInPandas(run, schema), [*keys, order])
