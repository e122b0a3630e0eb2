"""Compile a logic tree over leaf signals to one DataFrame plan.

Signals stay long until here; a pivot makes one column per leaf, and inner nodes become columns
over windows of the same partition keys, so that composing adds no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesift.config import TreeRules
from cuesift.operators.blocks import rescale_blocks, right_after_blocks, seq_blocks
from cuesift.operators.logic import AND_MODES, fuzzy_and, fuzzy_or, right_after, seq
from cuesift.plans.tree import MissingLeaf, Node

FLAT = 1e-8


def pivot(signals: DataFrame, node_ids: Sequence[int], keys: Sequence[str] = ("video_id", "qid"), order: str = "frame_idx", score: str = "score") -> DataFrame:
    """(keys, frame, node_id, score) -> (keys, frame, n0, n1, ...)."""
    return signals.groupBy(*keys, order).agg(*[F.max(F.when(F.col("node_id") == i, F.col(score))).alias(f"n{i}") for i in node_ids])


def _rescaled(df: DataFrame, columns: Sequence[str], lo: float, hi: float, keys: Sequence[str]) -> DataFrame:
    """Columns c -> r_c between lo and hi over the timeline; a flat one becomes their middle."""
    w = Window.partitionBy(*keys)
    df = df.select("*", *[f(c).over(w).alias(f"_{p}_{c}") for c in columns for f, p in ((F.min, "lo"), (F.max, "hi"))])
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        df = df.withColumn(f"r_{c}", F.when(span > FLAT, lo + (hi - lo) * (F.col(c) - F.col(f"_lo_{c}")) / span).otherwise(F.lit((lo + hi) / 2)))
    return df.drop(*[f"_{p}_{c}" for c in columns for p in ("lo", "hi")])


def evaluate(wide: DataFrame, tree: Node, config: TreeRules, fps: float = 1.0, keys: Sequence[str] = ("video_id", "qid"), order: str = "frame_idx", mode: str = "plain", out: str = "score") -> DataFrame:
    """``wide`` with ``out``: the tree's truth at each frame, from leaf columns n0, n1, ...

    mode plain: operators on signals as they are; rescaled: every child is scaled to ``config.scale``
    over its timeline before its parent's operator; restandardized: plain, but the branches of an OR
    at the root are scaled to 0..1 (flat ones to 0). Nodes of one height share their windows. With ``config.block`` SEQ, RIGHT_AFTER and
    scaling go by blocks, so that no task holds a timeline (restandardized ORs still do).
    """
    tree.validate()
    if config.conjunction not in AND_MODES:
        raise ValueError(f"unknown AND mode {config.conjunction!r}; one of {AND_MODES}")
    if missing := [f"n{leaf.node_id}" for leaf in tree.leaves() if f"n{leaf.node_id}" not in wide.columns]:
        raise MissingLeaf(f"no signal for {missing}")
    names: dict[tuple[int, ...], str] = {}
    heights: dict[int, list[tuple[tuple[int, ...], Node]]] = {}
    number = iter(range(10_000))

    def place(node: Node, path: tuple[int, ...]) -> int:
        if node.is_leaf:
            names[path] = f"n{next(number)}"
            height = 0
        else:
            height = 1 + max(place(c, (*path, i)) for i, c in enumerate(node.children))
            names[path] = "t" + "_".join(map(str, path or ("",)))
        heights.setdefault(height, []).append((path, node))
        return height

    top = place(tree, ())
    df, before = wide, set(wide.columns)
    for height in range(top + 1):
        nodes = heights.get(height, [])
        for path, node in nodes if height else []:
            df = _apply(df, node, [_operand(names[(*path, i)], mode) for i in range(len(node.children))], names[path], config, fps, keys, order, root=not path, mode=mode)
        if mode == "rescaled" and (scaled := [names[path] for path, _ in nodes if path]):
            df = rescale_blocks(df, scaled, *config.scale, keys, FLAT) if config.block else _rescaled(df, scaled, *config.scale, keys)
    result = df.withColumn("_truth", F.col(names[()]))
    return result.drop(*[c for c in df.columns if c not in before]).withColumnRenamed("_truth", out)


def _operand(name: str, mode: str) -> str:
    return f"r_{name}" if mode == "rescaled" else name


def _apply(df: DataFrame, node: Node, operands: list[str], out: str, config: TreeRules, fps: float, keys, order, root: bool, mode: str) -> DataFrame:
    if node.op == "SEQ":
        return seq_blocks(df, operands, keys, out, order, config.block) if config.block else seq(df, operands, keys, out, order)
    if node.op == "RIGHT_AFTER" and config.block:
        return right_after_blocks(df, *operands, keys, out, config.decay, fps, order, config.block)
    if node.op == "RIGHT_AFTER":
        return right_after(df, *operands, keys, out, config.decay, fps, order)
    if node.op == "OR" and root and mode == "restandardized":
        w = Window.partitionBy(*keys)
        df = df.select("*", *[f(c).over(w).alias(f"_{p}_{c}") for c in operands for f, p in ((F.min, "lo"), (F.max, "hi"))])
        scaled = [F.when(F.col(f"_hi_{c}") - F.col(f"_lo_{c}") > FLAT, (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(F.lit(0.0)) for c in operands]
        return df.withColumn(out, fuzzy_or(scaled)).drop(*[f"_{p}_{c}" for c in operands for p in ("lo", "hi")])
    columns = [F.col(c) for c in operands]
    return df.withColumn(out, fuzzy_and(columns, config.conjunction) if node.op == "AND" else fuzzy_or(columns))


def compose(wide: DataFrame, tree: Node, config: TreeRules, fps: float = 1.0, keys: Sequence[str] = ("video_id", "qid"), order: str = "frame_idx", out: str = "score") -> DataFrame:
    """The truth curve by ``config.join``: the tree, or the mean or product of the leaves at hand."""
    if config.join == "tree":
        mode = "rescaled" if config.scale else "restandardized" if config.restandardise else "plain"
        return evaluate(wide, tree, config, fps, keys, order, mode, out)
    leaves = [F.col(f"n{leaf.node_id}") for leaf in tree.leaves() if f"n{leaf.node_id}" in wide.columns]
    if config.join == "additive":
        return wide.withColumn(out, _mean(leaves))
    if config.join == "multiplicative":
        return wide.withColumn(out, reduce(lambda a, b: a * b, leaves))
    raise ValueError(f"unknown composition {config.join!r}")


def _mean(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / len(columns)
