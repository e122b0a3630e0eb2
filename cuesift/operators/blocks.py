"""Operators over timelines that are too long for one task.

The window operators hold a timeline in one partition. Here a timeline is cut into blocks of
positions that are spread over the cluster; what a block has to know of the others is a few numbers for each block (its
greatest value, its decayed sum, its count), carried along the much shorter row of blocks, or a few rows of its
neighbours. Results are those of the windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cuesift.operators.logic import faded
from cuesift.operators.normalize import sigmoid
from cuesift.operators.smooth import kernel
from cuesift.sources.scratch import new_path

#: Frames of a block.
BLOCK = 1 << 16
#: Bins of a round of ``exact_medians``, and values that are few enough to be sorted.
BINS, FEW = 1024, 1 << 14


def numbered(df: DataFrame, keys: Sequence[str], order: str = "frame_idx", block: int = BLOCK, dense: bool = False) -> DataFrame:
    """``df`` with _pos (place in the timeline, from 0) and _block (places dealt in blocks of the same length).

    ``order`` is a whole number. With ``dense`` it is the place already (a frame grid from 0); otherwise stretches of it are counted first and
    the counts added up along the timeline, so that no task sees more rows than a stretch has.
    """
    if dense:
        pos = F.col(order).cast("long")
    else:
        df = df.withColumn("_s", F.floor(F.col(order) / block))
        size = df.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        size = size.select(*keys, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        df = df.join(size, [*keys, "_s"])
        pos = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(order)) - 1 + F.col("_before")
    return df.withColumn("_pos", pos).withColumn("_block", F.floor(F.col("_pos") / block)).drop("_s", "_before")


def _carried(rows: DataFrame, keys: Sequence[str], columns: dict[str, tuple[Column, bool]]) -> DataFrame:
    """(keys, _block, names): for each block the greatest value of each column in earlier (or, if True, later) blocks, 0 at the end."""
    top = rows.groupBy(*keys, "_block").agg(*[F.max(c).alias(name) for name, (c, _) in columns.items()])
    out = []
    for name, (_, later) in columns.items():
        w = Window.partitionBy(*keys).orderBy(F.col("_block").desc() if later else F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
        out.append(F.coalesce(F.max(name).over(w), F.lit(0.0)).alias(f"_c{name}"))
    return top.select(*keys, "_block", *out)


def seq_blocks(df: DataFrame, operands: Sequence[str], keys: Sequence[str], out: str, order: str = "frame_idx", block: int = BLOCK, dense: bool = False) -> DataFrame:
    """As ``logic.seq``: running maxima within blocks, with the maxima of the blocks before and behind."""
    if len(operands) < 2:
        raise ValueError("SEQ needs two children or more")
    rows = numbered(df, keys, order, block, dense)
    gates = {f"_h{i}": (F.col(c), False) for i, c in enumerate(operands[:-1])} | {f"_f{i}": (F.col(c), True) for i, c in enumerate(operands) if i}
    rows = rows.join(_carried(rows, keys, gates), [*keys, "_block"])
    here = []
    for name, (c, later) in gates.items():
        w = Window.partitionBy(*keys, "_block").orderBy(F.col("_pos").desc() if later else F.col("_pos")).rowsBetween(Window.unboundedPreceding, -1)
        here.append(F.greatest(F.coalesce(F.max(c).over(w), F.lit(0.0)), F.col(f"_c{name}")).alias(name))
    rows = rows.select("*", *here)
    steps = []
    for i, c in enumerate(operands):
        past, future = [F.col(f"_h{j}") for j in range(i)], [F.col(f"_f{j}") for j in range(i + 1, len(operands))]
        steps.append(reduce(lambda a, b: a * b, [F.col(c), *past, *future]))
    return rows.withColumn("_y", F.greatest(*steps, F.lit(0.0))).select(*[F.col(c) for c in df.columns if c != out], F.col("_y").alias(out))


def smooth_blocks(df: DataFrame, sigma: float, keys: Sequence[str], score: str = "score", out: str = "score", order: str = "frame_idx", block: int = BLOCK, dense: bool = False) -> DataFrame:
    """As ``smooth.smooth``: each block is convolved with copies of the kernel's half width of rows from either neighbour."""
    w = np.array(kernel(sigma))
    r = len(w) // 2
    if not r:
        return df.withColumn(out, F.col(score))
    block = max(block, r)  # so that the halo comes from neighbours only
    rows = numbered(df, keys, order, block, dense)
    at, place = F.col("_pos") % block, F.col("_block")
    to = F.array_compact(F.array(place, F.when((at < r) & (place > 0), place - 1), F.when(at >= block - r, place + 1)))
    names = [c for c in df.columns if c != out]
    kept = [c for c in df.columns if c not in (*keys, order, score, out)]
    slim = rows.select(*keys, order, F.col(score).cast("double").alias("_x"), "_pos", F.explode(to).alias("_block"), place.alias("_own"))
    schema = StructType([*(df.schema[c] for c in keys), df.schema[order], StructField("_y", DoubleType())])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_pos", ignore_index=True)
        own = (t["_own"] == t["_block"]).to_numpy()
        if not own.any():  # copies of a block whose neighbour has no rows
            return t.iloc[:0].assign(_y=0.0)[[*keys, order, "_y"]]
        x = t["_x"].to_numpy()
        y = np.convolve(np.concatenate([np.full(r, x[0]), x, np.full(r, x[-1])]), w[::-1], "valid")
        return t.assign(_y=y)[own][[*keys, order, "_y"]]

    done = slim.groupBy(*keys, "_block").applyInPandas(run, schema)
    if not kept and score in (out, order):
        return done.withColumnRenamed("_y", out)
    return df.select(*names).join(done, [*keys, order]).select(*names, F.col("_y").alias(out))


def right_after_blocks(df: DataFrame, cause: str, effect: str, keys: Sequence[str], out: str, kappa: float = 2.0, fps: float = 1.0, order: str = "frame_idx", block: int = BLOCK, dense: bool = False) -> DataFrame:
    """As ``logic.right_after``, for any decay: sums within blocks, begun with the decayed sum of all blocks before (behind)."""
    rate = kappa / fps
    rows = numbered(df, keys, order, block, dense)
    slim = rows.select(*keys, order, "_block", "_pos", F.col(cause).cast("double").alias("_a"), F.col(effect).cast("double").alias("_b"))
    first, last = F.min("_pos").over(Window.partitionBy(*keys, "_block")), F.max("_pos").over(Window.partitionBy(*keys, "_block"))
    weighed = slim.select("*", (F.col("_a") * F.exp(-rate * (last + 1 - F.col("_pos")))).alias("_u"), (F.col("_b") * F.exp(-rate * (F.col("_pos") - first + 1))).alias("_v"))
    sums = weighed.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), F.sum("_u").alias("_u"), F.sum("_v").alias("_v"))
    ids = [sums.schema[c] for c in keys]
    carry = StructType([*ids, sums.schema["_block"], StructField("_past", DoubleType()), StructField("_next", DoubleType())])

    def carried(t: pd.DataFrame) -> pd.DataFrame:
        """The blocks of a timeline, in order: what their frames take over."""
        t = t.sort_values("_block", ignore_index=True)
        fade = np.exp(-rate * t["_n"].to_numpy())

        def along(x: np.ndarray, fade: np.ndarray) -> np.ndarray:
            h, out = 0.0, np.empty(len(x))
            for i in range(len(x)):
                out[i] = h
                h = h * fade[i] + x[i]
            return out

        past, behind = along(t["_u"].to_numpy(), fade), along(t["_v"].to_numpy()[::-1], fade[::-1])[::-1]
        return t.assign(_past=past, _next=behind)[[*keys, "_block", "_past", "_next"]]

    begun = slim.join(sums.groupBy(*keys).applyInPandas(carried, carry), [*keys, "_block"])
    schema = StructType([*(df.schema[c] for c in keys), df.schema[order], StructField("_y", DoubleType())])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_pos", ignore_index=True)
        a, b = t["_a"].to_numpy(), t["_b"].to_numpy()
        fade = np.exp(-rate * np.arange(len(t)))
        past = faded(a, rate) + t["_past"].to_numpy() * fade
        behind = faded(b[::-1], rate)[::-1] + t["_next"].to_numpy() * fade[::-1]
        return t.assign(_y=np.maximum(b * past, a * behind))[[*keys, order, "_y"]]

    done = begun.groupBy(*keys, "_block").applyInPandas(run, schema)
    names = [c for c in df.columns if c != out]
    return df.select(*names).join(done, [*keys, order]).select(*names, F.col("_y").alias(out))


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, few: int = FEW, bins: int = BINS) -> DataFrame:
    """(keys, median): exact, without a group in one task.

    Each round counts a group's values in equal bins between two bounds and goes on with the bin that holds the middle
    ranks, with that bin's own least and greatest value as bounds, until few values are left; these are sorted. The state of a round, a row
    for each group, is a table. Nulls don't count; a group without values has a null median.
    """
    if not keys:
        return exact_medians(df.select(F.lit(0).alias("_g"), value), ["_g"], value, few, bins).drop("_g")
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    # both middle ranks (from 0) among the values from _lo on, and how many are between the bounds
    state = _table(size.select(*keys, F.expr("(_n - 1) div 2").alias("_r"), F.expr("_n div 2").alias("_q"), F.col("_n").alias("_m"), "_lo", "_hi"))
    small, done = (F.col("_m") <= few) | (F.col("_lo") == F.col("_hi")), []
    while True:
        done.append(_sorted_middles(rows, state.where(small), keys))
        if not (rest := state.where(~small)).take(1):
            break
        span = F.col("_hi") / bins - F.col("_lo") / bins
        inside = _within(rows, rest, keys).withColumn("_bin", F.least(F.floor((F.col("_x") - F.col("_lo")) / span), F.lit(bins - 1)))
        count = inside.groupBy(*keys, "_r", "_q", "_bin").agg(F.count("*").alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        w = Window.partitionBy(*keys).orderBy("_bin")
        count = count.withColumn("_end", F.sum("_m").over(w)).withColumn("_start", F.col("_end") - F.col("_m")).withColumn("_after", F.lead("_lo").over(w))
        hit = _table(count.where("_start <= _r and _r < _end"))
        # a pair of middle ranks that the bin's end parts is known: its greatest value and the next bin's least
        done.append(hit.where("_q >= _end").select(*keys, ((F.col("_hi") + F.col("_after")) / 2).alias("median")))
        state = hit.where("_q < _end").select(*keys, (F.col("_r") - F.col("_start")).alias("_r"), (F.col("_q") - F.col("_start")).alias("_q"), "_m", "_lo", "_hi")
    return df.select(*keys).distinct().join(reduce(DataFrame.unionByName, done), list(keys), "left")


def _table(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _within(rows: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values between their group's bounds, which are a row for each group."""
    return rows.join(bounds, list(keys)).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))


def _sorted_middles(rows: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The medians of groups of which few values, or equal ones only, are between the bounds."""
    equal = bounds.where("_lo = _hi").select(*keys, F.col("_lo").alias("median"))
    some = _within(rows, bounds.where("_lo < _hi"), keys)
    sorted_ = some.groupBy(*keys, "_r", "_q").agg(F.sort_array(F.collect_list("_x")).alias("_v"))
    at = lambda c: F.get("_v", F.col(c).cast("int"))
    return equal.unionByName(sorted_.select(*keys, ((at("_r") + at("_q")) / 2).alias("median")))


def normalize_blocks(df: DataFrame, keys: Sequence[str], method: str = "robust", score: str = "score", out: str = "score", delta: float = 1e-6, gamma: float = 3.0) -> DataFrame:
    """As ``normalize.normalize``, statistics being aggregations that are joined with the rows, not windows over whole timelines."""
    x, names = F.col(score), [c for c in df.columns if c != out]
    if method == "robust":
        middle = exact_medians(df, keys, score).withColumnRenamed("median", "_m")
        df = df.join(middle, list(keys)).withColumn("_d", F.abs(x - F.col("_m")))
        df = df.join(exact_medians(df, keys, "_d").withColumnRenamed("median", "_mad"), list(keys))
        y = sigmoid(gamma * (x - F.col("_m")) / (F.col("_mad") + delta))
    elif method == "minmax":
        cut = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        df = df.join(df.groupBy(*keys).agg(F.min(cut).alias("_lo"), F.max(cut).alias("_hi")), list(keys))
        span = F.col("_hi") - F.col("_lo")
        y = F.when(span > delta, (cut - F.col("_lo")) / span).otherwise(F.lit(0.0))
    elif method == "zscore":
        df = df.join(df.groupBy(*keys).agg(F.avg(x).alias("_avg"), F.stddev_pop(x).alias("_sd")), list(keys))
        y = sigmoid(gamma * (x - F.col("_avg")) / (F.col("_sd") + delta))
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    return df.select(*names, y.alias(out))


def rescale_blocks(df: DataFrame, columns: Sequence[str], lo: float, hi: float, keys: Sequence[str], flat: float = 1e-8) -> DataFrame:
    """As the compiler's scaling of columns c to r_c, least and greatest value being an aggregation that is joined."""
    ends = df.groupBy(*keys).agg(*[f(c).alias(f"_{p}_{c}") for c in columns for f, p in ((F.min, "lo"), (F.max, "hi"))])
    df = df.join(ends, list(keys))
    span = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    scaled = [F.when(span(c) > flat, lo + (hi - lo) * (F.col(c) - F.col(f"_lo_{c}")) / span(c)).otherwise(F.lit((lo + hi) / 2)).alias(f"r_{c}") for c in columns]
    return df.select("*", *scaled).drop(*[f"_{p}_{c}" for c in columns for p in ("lo", "hi")])
