"""Normalisation of signals: robust, min-max and z-score, each signal alone or a group jointly.

Everything is a window over the rows' partition, so a pipeline that is already partitioned by
video adds no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesift.functions.text import is_short

METHODS = ("robust", "minmax", "zscore")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-50.0)), F.lit(50.0))))


def normalize(df: DataFrame, by: Sequence[str], method: str = "robust", score: str = "score", out: str = "score", delta: float = 1e-6, gamma: float = 3.0) -> DataFrame:
    """``df`` with ``out``: ``score`` relative to all rows that agree in ``by``.

    robust: sigmoid(gamma (x - median) / (median absolute deviation + delta)); where most rows are alike
    the deviation is 0 and the result has two levels. minmax: scaled after a cut to 0..1, constant signals
    give 0. zscore: sigmoid(gamma z) with the population deviation + delta.
    """
    if method not in METHODS:
        raise ValueError(f"unknown normalisation {method!r}; one of {METHODS}")
    w, x = Window.partitionBy(*by), F.col(score)
    if method == "robust":
        df = df.withColumn("_m", F.median(x).over(w)).withColumn("_d", F.abs(x - F.col("_m")))
        df = df.withColumn("_mad", F.median("_d").over(w))
        return df.withColumn(out, sigmoid(gamma * (x - F.col("_m")) / (F.col("_mad") + delta))).drop("_m", "_d", "_mad")
    if method == "minmax":
        cut = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        df = df.withColumn("_x", cut).withColumn("_lo", F.min("_x").over(w)).withColumn("_hi", F.max("_x").over(w))
        span = F.col("_hi") - F.col("_lo")
        return df.withColumn(out, F.when(span > delta, (F.col("_x") - F.col("_lo")) / span).otherwise(F.lit(0.0))).drop("_x", "_lo", "_hi")
    df = df.withColumn("_avg", F.avg(x).over(w)).withColumn("_sd", F.stddev_pop(x).over(w))
    return df.withColumn(out, sigmoid(gamma * (x - F.col("_avg")) / (F.col("_sd") + delta))).drop("_avg", "_sd")


def expert_group(expert: Column, query: Column) -> Column:
    """The group of signals that are normalised together: the expert, speech split by the query's length."""
    return F.when(expert == "ASR", F.when(is_short(query), F.lit("ASR_short")).otherwise(F.lit("ASR_long"))).otherwise(expert)


def normalize_joint(df: DataFrame, method: str = "robust", by: Sequence[str] = ("video_id", "qid"), **options) -> DataFrame:
    """Signals (by, expert, query, frame_idx, score) with shared statistics for each expert group.

    A query that occurs twice counts once in the statistics: rows are weighed down to the
    first of each (expert, query, frame), the others take its value.
    """
    grouped = df.withColumn("expert_group", expert_group(F.col("expert"), F.col("query")))
    keys = [*by, "expert_group"]
    if "node_id" not in df.columns:
        return normalize(grouped, keys, method, **options).drop("expert_group")
    one = Window.partitionBy(*keys, "query", "frame_idx")
    first = grouped.withColumn("_first", F.min("node_id").over(one) == F.col("node_id"))
    score, out = options.get("score", "score"), options.get("out", "score")
    masked = first.withColumn("_s", F.when(F.col("_first"), F.col(score)))
    done = normalize(masked, keys, method, **{**options, "score": "_s", "out": "_y"})
    return done.withColumn(out, F.max("_y").over(one)).drop("_first", "_s", "_y", "expert_group")
