"""Trees as rows against the compiler and against plain NumPy."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesift.config import TreeRules
from cuesift.plans.compiler import compose, pivot
from cuesift.plans.leveled import leaf_table, leveled_curves
from cuesift.plans.tree import Node

FRAMES = 12
PLAIN = replace(TreeRules(), scale=None, restandardise=False)


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return Node.leaf("CLIP", f"v{rng.randrange(4)}")
    op = rng.choice(["AND", "OR", "SEQ", "RIGHT_AFTER"])
    n = 2 if op == "RIGHT_AFTER" else rng.randrange(2 if op == "SEQ" else 1, 4)
    return Node.of(op, *[grown(rng, depth - 1) for _ in range(n)])


def truth(node, scores, config, root=True):
    """``scores``: the leaves' curves in order (consumed)."""
    if node.is_leaf:
        return next(scores)
    xs = [truth(c, scores, config, False) for c in node.children]
    if config.scale:
        lo, hi = config.scale
        xs = [lo + (hi - lo) * (x - x.min()) / np.ptp(x) if np.ptp(x) > 1e-8 else np.full(len(x), (lo + hi) / 2) for x in xs]
    elif config.restandardise and root and node.op == "OR":
        xs = [(x - x.min()) / np.ptp(x) if np.ptp(x) > 1e-8 else np.zeros(len(x)) for x in xs]
    if node.op == "AND":
        return np.minimum.reduce(xs) if config.conjunction == "min" else np.prod(xs, 0) ** (1 / len(xs) if config.conjunction == "geometric_mean" else 1)
    if node.op == "OR":
        return 1 - np.prod([1 - x for x in xs], 0)
    n = len(xs[0])
    if node.op == "SEQ":
        past = [np.array([max(x[:t], default=0) for t in range(n)]) for x in xs]
        future = [np.array([max(x[t + 1 :], default=0) for t in range(n)]) for x in xs]
        return np.maximum(np.max([np.prod([x, *past[:i], *future[i + 1 :]], 0) for i, x in enumerate(xs)], 0), 0)
    decay = lambda x, t, s: x[s] * math.exp(-config.decay * abs(t - s))
    return np.array([max(xs[1][t] * sum(decay(xs[0], t, s) for s in range(t)), xs[0][t] * sum(decay(xs[1], t, s) for s in range(t + 1, n))) for t in range(n)])


def made(spark, trees, videos=1, seed=5):
    rng = np.random.default_rng(seed)
    rows, curves = [], {}
    for i, tree in enumerate(trees):
        for v in range(videos):
            own = [np.round(rng.random(FRAMES), 3) if rng.random() > 0.1 else np.full(FRAMES, 0.25) for _ in tree.leaves()]
            curves[f"v{v}", f"q{i}"] = own
            rows += [(f"v{v}", f"q{i}", k, f, float(x)) for k, xs in enumerate(own) for f, x in enumerate(xs)]
    signals = spark.createDataFrame(rows, "video_id string, qid string, node_id int, frame_idx int, score double").repartition("video_id", "qid")
    leaves = leaf_table(spark.createDataFrame([(f"q{i}", t.to_json()) for i, t in enumerate(trees)], "qid string, tree string"))
    return signals, leaves, curves


def as_dict(df):
    return {(r.video_id, r.qid, r.frame_idx): r.score for r in df.collect()}


@pytest.mark.parametrize("config", [PLAIN, replace(PLAIN, conjunction="min", scale=(0.2, 0.9)), replace(PLAIN, conjunction="geometric_mean", restandardise=True, decay=0.05)])
def test_many_shapes_one_plan(spark, config):
    rng = random.Random(3)
    trees = [grown(rng, 3) for _ in range(300)]
    signals, leaves, curves = made(spark, trees)
    got = as_dict(leveled_curves(signals, leaves, config))
    assert len(got) == 300 * FRAMES
    for (v, q), own in curves.items():
        want = truth(trees[int(q[1:])], iter(own), config)
        assert [got[v, q, f] for f in range(FRAMES)] == pytest.approx(want.tolist(), abs=1e-9, nan_ok=True), trees[int(q[1:])]


def test_plan_does_not_grow_with_shapes(spark):
    sizes = []
    for n in (3, 200):
        trees = [Node.of("AND", *[Node.of("OR", *[Node.leaf("CLIP", f"v{j}") for j in range(1 + i % 7)]) for _ in range(1 + i // 7)]) for i in range(n)]
        signals, leaves, _ = made(spark, trees[:n])
        sizes.append(len(leveled_curves(signals, leaves, PLAIN)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_equal_to_the_compiler(spark):
    rng = random.Random(8)
    trees = [grown(rng, 2) for _ in range(4)]
    signals, leaves, _ = made(spark, trees, 2)
    for config in (TreeRules(), replace(PLAIN, join="additive"), replace(PLAIN, join="multiplicative")):
        got = as_dict(leveled_curves(signals, leaves, config, 2.0))
        for i, tree in enumerate(trees):
            wide = pivot(signals.where(F.col("qid") == f"q{i}"), [x.node_id for x in tree.leaves()])
            for key, y in as_dict(compose(wide, tree, config, 2.0)).items():
                assert got[key] == pytest.approx(y, abs=1e-12)


def test_odd_tables(spark):
    leaf, pair = Node.leaf("CLIP", "a"), Node.of("AND", Node.leaf("CLIP", "a"), Node.leaf("CLIP", "b"))
    signals, leaves, curves = made(spark, [leaf, pair])
    got = as_dict(leveled_curves(signals, leaves, PLAIN))
    assert [got["v0", "q0", f] for f in range(FRAMES)] == curves["v0", "q0"][0].tolist()
    lacking = as_dict(leveled_curves(signals.where("not (node_id = 1 and frame_idx = 3)"), leaves, PLAIN))
    assert lacking["v0", "q1", 3] is None and lacking["v0", "q1", 4] == got["v0", "q1", 4]
    assert leveled_curves(signals.where("false"), leaves, TreeRules()).count() == 0
    with pytest.raises(ValueError):
        leveled_curves(signals, leaves, replace(PLAIN, conjunction="most"))
    with pytest.raises(ValueError):
        leveled_curves(signals, leaves, replace(PLAIN, join="somehow"))
