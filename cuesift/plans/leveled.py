"""Trees as rows: the truth curves of any number of trees in one plan, whatever their shapes.

A leaf's row knows its ancestors. Trees are evaluated by height: at each height the children of a node are one group, the rest passes
through; nodes' values are rows, so the plan grows with the greatest height alone. All steps are windows and groups of
one timeline and question, so there is one exchange (a leaf table too large to be broadcast adds two).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cuesift.config import TreeRules
from cuesift.operators.logic import AND_MODES, CUT, MOST_LAGS, faded
from cuesift.plans.compiler import FLAT
from cuesift.plans.tree import Node

_UP = "array<struct<node: int, op: string, at: int, n: int, height: int>>"
_LEAVES = f"node_id int, node int, up {_UP}, expert string, query string"


def _leaf_rows(tree: Node) -> list[dict]:
    """A tree's leaves in order with their ancestors, the nearest first; nodes are numbered from the root, 0."""
    out, numbers = [], iter(range(1 << 31))

    def walk(node: Node, up: list[dict]) -> None:
        number = next(numbers)
        if node.is_leaf:
            out.append({"node_id": len(out), "node": number, "up": up, "expert": node.expert, "query": node.query})
        height = node.height()
        for i, child in enumerate(node.children):
            walk(child, [{"node": number, "op": node.op, "at": i, "n": len(node.children), "height": height}, *up])

    walk(tree, [])
    return out


def leaf_table(trees: DataFrame, key: str = "qid", tree: str = "tree") -> DataFrame:
    """(key, tree as JSON) -> a row per leaf: key, node_id, node, up (ancestors), expert, query. Invalid trees fail."""
    schema = StructType([trees.schema[key], *StructType.fromDDL(_LEAVES).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text in zip(batch[key], batch[tree], strict=True):
                yield pd.DataFrame([{key: k, **row} for row in _leaf_rows(Node.from_dict(json.loads(text)))])

    return trees.select(key, F.col(tree).cast("string").alias(tree)).mapInPandas(run, schema)


def _product(xs: Column, value=lambda x: x) -> Column:
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), value(F.get(xs, F.lit(0))), lambda a, x: a * value(x))


def _or(xs: Column) -> Column:
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0))["score"], lambda a, x: a + x["score"] - a * x["score"])


def _and(xs: Column, mode: str) -> Column:
    if mode == "min":
        return F.array_min(F.transform(xs, lambda x: x["score"]))
    product = _product(xs, lambda x: x["score"])
    return product if mode == "product" else F.when(F.size(xs) == 1, product).otherwise(F.pow(product, 1 / F.size(xs)))


def _seq(xs: Column) -> Column:
    def step(x: Column, i: Column) -> Column:
        past = F.aggregate(F.slice(xs, F.lit(1), i), x["score"], lambda a, y: a * y["past"])
        return F.aggregate(F.slice(xs, i + 2, F.size(xs)), past, lambda a, y: a * y["future"])

    return F.greatest(F.array_max(F.transform(xs, step)), F.lit(0.0))


def _right_after(xs: Column) -> Column:
    cause, effect = F.get(xs, F.lit(0)), F.get(xs, F.lit(1))
    return F.greatest(effect["score"] * cause["past"], cause["score"] * effect["future"])


def _gates(df: DataFrame, ops: set[str], rate: float, timeline: Sequence[str], order: str) -> DataFrame:
    """``past`` and ``future`` of each value: greatest values (SEQ) or decayed sums (RIGHT_AFTER) before and after its frame."""
    op = F.get("up", F.lit(0))["op"]
    w, back = Window.partitionBy(*timeline).orderBy(order), Window.partitionBy(*timeline).orderBy(F.col(order).desc())
    before = [F.coalesce(F.max("score").over(x.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) for x in (w, back)]
    reach = math.ceil(CUT / rate)
    if "RIGHT_AFTER" not in ops:
        return df.select("*", before[0].alias("past"), before[1].alias("future"))
    if reach > MOST_LAGS:
        df = _faded_rows(df, rate, timeline, order)
        sums = [F.col("_past"), F.col("_future")]
    else:
        shifted = [[F.coalesce(f("score", d).over(w), F.lit(0.0)).alias(f"_{p}{d}") for d in range(1, reach + 1)] for f, p in ((F.lag, "b"), (F.lead, "a"))]
        df = df.select("*", *shifted[0], *shifted[1])
        sums = []
        for p in "ba":
            total = F.lit(0.0)
            for d in range(1, reach + 1):
                total = total + F.col(f"_{p}{d}") * math.exp(-rate * d)
            sums.append(total)
    found = [F.when(op == "RIGHT_AFTER", s).otherwise(b) if "SEQ" in ops else s for s, b in zip(sums, before, strict=True)]
    return df.select("*", found[0].alias("past"), found[1].alias("future")).drop(*[c for c in df.columns if c[:2] in ("_b", "_a") and c[2:].isdigit()], "_past", "_future")


def _faded_rows(df: DataFrame, rate: float, timeline: Sequence[str], order: str) -> DataFrame:
    """For slow decay: the sums of a whole timeline at once."""
    keys = [*timeline, order]
    schema = StructType([*(df.schema[c] for c in keys), StructField("_past", DoubleType()), StructField("_future", DoubleType())])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order, ignore_index=True)
        x = np.nan_to_num(t["score"].to_numpy(float))
        return t[keys].assign(_past=faded(x, rate), _future=faded(x[::-1], rate)[::-1])

    return df.join(df.select(*keys, "score").groupBy(*timeline).applyInPandas(run, schema), keys)


def leveled_curves(signals: DataFrame, leaves: DataFrame, config: TreeRules, fps: float = 1.0, keys: Sequence[str] = ("video_id", "qid"), order: str = "frame_idx") -> DataFrame:
    """Signals (keys, node_id, frame, score) and ``leaf_table`` by qid -> (keys, frame, score), each tree's truth by ``config.join``.

    The same values as ``compiler.compose`` for each tree. A frame where some leaf has a score and another hasn't counts the
    other as null, which products and sums pass on and minima and maxima leave out. ``config.block`` isn't for this path.
    """
    if config.conjunction not in AND_MODES:
        raise ValueError(f"unknown AND mode {config.conjunction!r}; one of {AND_MODES}")
    if config.join not in ("tree", "additive", "multiplicative"):
        raise ValueError(f"unknown composition {config.join!r}")
    qid = keys[-1]
    own = leaves.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("node_id", "node", "up"))).alias("_leaves"))
    at_frame = signals.groupBy(*keys, order).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "score"))).alias("_scores"))
    wide = at_frame.join(own, qid)
    score = lambda x: F.try_element_at("_scores", x["node_id"])
    if config.join != "tree":
        have = F.filter(F.transform("_leaves", score), lambda x: x.isNotNull())
        total = F.aggregate(F.transform("_leaves", score), F.lit(0.0), lambda a, x: a + x) / F.size("_leaves") if config.join == "additive" else F.aggregate(F.transform("_leaves", score), F.lit(1.0), lambda a, x: a * x)
        return wide.select(*keys, order, F.when(F.size(have) > 0, total).alias("score"))
    steps = {}
    for row in leaves.select(F.explode("up").alias("u")).select("u.height", "u.op").distinct().collect():  # at most four rows for each height
        steps.setdefault(row["height"], set()).add(row["op"])
    df = wide.select(*keys, order, F.explode(F.transform("_leaves", lambda x: F.struct(x["node"].alias("node"), x["up"].alias("up"), score(x).alias("score")))).alias("x")).select(*keys, order, "x.*")
    for height in sorted(steps):
        df = _level(df, height, steps[height], config, fps, keys, order)
    return df.select(*keys, order, "score")


def _level(df: DataFrame, height: int, ops: set[str], config: TreeRules, fps: float, keys: Sequence[str], order: str) -> DataFrame:
    """Values of the nodes of one height from those of their children; other rows pass."""
    timeline = [*keys, "node"]
    parent = F.get("up", F.lit(0))
    active = F.coalesce(parent["height"] == height, F.lit(False))
    if config.scale or config.restandardise:
        w = Window.partitionBy(*timeline)
        df = df.select("*", F.min("score").over(w).alias("_lo"), F.max("score").over(w).alias("_hi"))
        lo, hi = config.scale or (0.0, 1.0)
        span, flat = F.col("_hi") - F.col("_lo"), (lo + hi) / 2 if config.scale else 0.0
        some = active if config.scale else active & (parent["op"] == "OR") & (F.size("up") == 1)
        scaled = F.when(span > FLAT, lo + (hi - lo) * (F.col("score") - F.col("_lo")) / span).otherwise(F.lit(flat))
        df = df.withColumn("score", F.when(some, scaled).otherwise(F.col("score"))).drop("_lo", "_hi")
    if ops & {"SEQ", "RIGHT_AFTER"}:
        df = _gates(df, ops, config.decay / fps, timeline, order)
    else:
        df = df.withColumn("past", F.lit(0.0)).withColumn("future", F.lit(0.0))
    df = df.withColumn("_active", active).withColumn("_node", F.when(active, parent["node"]).otherwise(F.col("node")))
    child = F.struct(F.when(F.col("_active"), parent["at"]).otherwise(F.lit(0)).alias("at"), "score", "past", "future")
    op = F.when(F.col("_active"), parent["op"]).otherwise(F.lit("LEAF"))
    rest = F.when(F.col("_active"), F.slice("up", F.lit(2), F.greatest(F.size("up") - 1, F.lit(0)))).otherwise(F.col("up"))
    rows = df.withColumn("_op", op).withColumn("_rest", rest).groupBy(*keys, order, "_node").agg(F.array_sort(F.collect_list(child)).alias("_x"), F.first("_op").alias("_op"), F.first("_rest").alias("up"))
    xs = F.col("_x")
    value = F.get(xs, F.lit(0))["score"]
    made = {"AND": lambda: _and(xs, config.conjunction), "OR": lambda: _or(xs), "SEQ": lambda: _seq(xs), "RIGHT_AFTER": lambda: _right_after(xs)}
    for name in sorted(ops):
        value = F.when(F.col("_op") == name, made[name]()).otherwise(value)
    return rows.select(*keys, order, F.col("_node").alias("node"), "up", value.alias("score"))
