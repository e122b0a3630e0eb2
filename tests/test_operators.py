"""Signals through Spark against plain NumPy written from the definitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuesift.config import SignalRules, TreeRules
from cuesift.operators import logic
from cuesift.operators.normalize import normalize, normalize_joint
from cuesift.operators.select import PeaksAndSpread, ScoreRanked, create_strategy, find_peaks, select
from cuesift.operators.smooth import kernel, smooth, smooth_by_expert
from cuesift.plans.compiler import MissingLeaf, compose, evaluate, pivot
from cuesift.plans.tree import Node

KEYS = ["video_id", "qid"]
L = Node.leaf


def wide(spark, *curves):
    rows = [("v", "q", i, *map(float, x)) for i, x in enumerate(zip(*curves, strict=True))]
    return spark.createDataFrame(rows, "video_id string, qid string, frame_idx int, " + ", ".join(f"n{i} double" for i in range(len(curves))))


def long(spark, curves, expert="CLIP"):
    rows = [("v", "q", n, expert, name, i, float(x)) for n, (name, c) in enumerate(curves) for i, x in enumerate(c)]
    return spark.createDataFrame(rows, "video_id string, qid string, node_id int, expert string, query string, frame_idx int, score double")


def values(df, column="score"):
    return df.orderBy("frame_idx").toPandas()[column].to_numpy()


def sig(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def robust(x, all_=None):
    a = x if all_ is None else all_
    m = np.median(a)
    return sig(3 * (x - m) / (np.median(np.abs(a - m)) + 1e-6))


RNG = np.random.default_rng(5)
CURVE = RNG.random(40)


@pytest.mark.parametrize("x", [CURVE, np.r_[np.zeros(20), 0.4, np.zeros(5)], np.full(7, 0.5)])
def test_normalisation(spark, x):
    df = long(spark, [("a", x)])
    by = [*KEYS, "node_id"]
    np.testing.assert_allclose(values(normalize(df, by)), robust(x), atol=1e-9)
    cut, span = np.clip(x, 0, 1), np.ptp(np.clip(x, 0, 1))
    np.testing.assert_allclose(values(normalize(df, by, "minmax")), (cut - cut.min()) / span if span > 1e-6 else 0 * cut, atol=1e-9)
    np.testing.assert_allclose(values(normalize(df, by, "zscore")), sig(3 * (x - x.mean()) / (x.std() + 1e-6)), atol=1e-9)


def test_unknown_normalisation(spark):
    with pytest.raises(ValueError):
        normalize(long(spark, [("a", [1])]), KEYS, "nope")


def test_joint_normalisation_counts_a_repeated_query_once(spark):
    a, b = RNG.random(15), RNG.random(15) * 0.3
    got = normalize_joint(long(spark, [("a", a), ("b", b), ("a", a)]))
    both = np.r_[a, b]
    for node, x in ((0, a), (1, b), (2, a)):
        np.testing.assert_allclose(values(got.where(f"node_id = {node}")), robust(x, both), atol=1e-9)


def test_joint_groups_of_speech_are_split_by_length(spark):
    a, b = RNG.random(15), RNG.random(15) * 0.3
    got = normalize_joint(long(spark, [("hello you", a), ("what was said then", b)], "ASR"))
    np.testing.assert_allclose(values(got.where("node_id = 0")), robust(a), atol=1e-9)
    np.testing.assert_allclose(values(got.where("node_id = 1")), robust(b), atol=1e-9)


@pytest.mark.parametrize("sigma", [0.5, 1.5, 2.0, 9.0])
def test_smoothing_is_an_edge_padded_convolution(spark, sigma):
    w = np.array(kernel(sigma))
    r = len(w) // 2
    assert r == int(4 * sigma + 0.5) and abs(w.sum() - 1) < 1e-12
    expect = np.convolve(np.pad(CURVE, r, mode="edge"), w, mode="valid")
    np.testing.assert_allclose(values(smooth(long(spark, [("a", CURVE)]), sigma, [*KEYS, "node_id"])), expect, atol=1e-12)


def test_smoothing_by_expert_and_without_width(spark):
    impulse = np.eye(1, 31, 15)[0]
    df = long(spark, [("a", impulse)]).unionByName(long(spark, [("b", impulse)], "ASR").withColumn("node_id", F.lit(1)))
    got = smooth_by_expert(df, SignalRules(), 1.0, [*KEYS, "node_id"])
    visual, speech = values(got.where("node_id = 0")), values(got.where("node_id = 1"))
    assert visual.max() > speech.max() and (speech > 1e-4).sum() > (visual > 1e-4).sum()
    np.testing.assert_allclose(speech, np.convolve(np.pad(impulse, 6, mode="edge"), kernel(1.5), mode="valid"), atol=1e-12)
    np.testing.assert_allclose(values(smooth(long(spark, [("a", CURVE)]), 0, [*KEYS, "node_id"])), CURVE)


def np_seq(*s):
    n, out = len(s[0]), []
    for t in range(n):
        h = [max(x[:t], default=0) for x in s]
        f = [max(x[t + 1 :], default=0) for x in s]
        out.append(max(0, *[s[i][t] * math.prod(h[:i]) * math.prod(f[i + 1 :]) for i in range(len(s))]))
    return np.array(out)


def np_right_after(c, e, kappa=2.0, fps=1.0):
    n = len(c)
    left = [e[t] * sum(c[s] * math.exp(-kappa * (t - s) / fps) for s in range(t)) for t in range(n)]
    right = [c[t] * sum(e[s] * math.exp(-kappa * (s - t) / fps) for s in range(t + 1, n)) for t in range(n)]
    return np.maximum(left, right)


def test_and_or(spark):
    df = wide(spark, [0.8, 0.5, 0.2], [0.6, 0.4, 0.9])
    a, b = F.col("n0"), F.col("n1")
    for mode, expect in (("product", [0.48, 0.2, 0.18]), ("min", [0.6, 0.4, 0.2]), ("geometric_mean", np.sqrt([0.48, 0.2, 0.18]))):
        np.testing.assert_allclose(values(df.withColumn("score", logic.fuzzy_and([a, b], mode))), expect)
    np.testing.assert_allclose(values(df.withColumn("score", logic.fuzzy_or([a, b]))), [0.92, 0.7, 0.92])
    with pytest.raises(ValueError):
        logic.fuzzy_and([a, b], "nope")


def test_seq(spark):
    s = [RNG.random(20) for _ in range(3)]
    np.testing.assert_allclose(values(logic.seq(wide(spark, *s), ["n0", "n1", "n2"], KEYS, "score")), np_seq(*s), atol=1e-12)
    forward = values(logic.seq(wide(spark, *s), ["n0", "n1", "n2"], KEYS, "score"))
    back = values(logic.seq(wide(spark, *[x[::-1] for x in s[::-1]]), ["n0", "n1", "n2"], KEYS, "score"))
    np.testing.assert_allclose(forward, back[::-1])
    with pytest.raises(ValueError):
        logic.seq(wide(spark, s[0]), ["n0"], KEYS, "score")


@pytest.mark.parametrize(("kappa", "fps"), [(2.0, 1.0), (2.0, 2.0), (0.1, 1.0)])
def test_right_after_by_lags_and_by_fold(spark, kappa, fps):
    c, e = RNG.random(30), RNG.random(30)
    np.testing.assert_allclose(values(logic.right_after(wide(spark, c, e), "n0", "n1", KEYS, "score", kappa, fps)), np_right_after(c, e, kappa, fps), atol=1e-12)


def test_faded_sums_over_many_blocks():
    x = RNG.random(3000)
    for rate in (0.05, 1.0, 5.0):
        h, expect = 0.0, []
        for v in x:
            expect.append(h)
            h = (h + v) * math.exp(-rate)
        np.testing.assert_allclose(logic.faded(x, rate)[1:], np.array([(expect[i - 1] + x[i - 1]) * math.exp(-rate) for i in range(1, 3000)]), rtol=1e-9)


def rescaled(x, lo=0.5, hi=1.0):
    return lo + (hi - lo) * (x - x.min()) / np.ptp(x) if np.ptp(x) > 1e-8 else np.full_like(x, (lo + hi) / 2)


def test_trees(spark):
    a, b, c, d = (RNG.random(25) for _ in range(4))
    df = wide(spark, a, b, c, d)
    tree = Node.of("AND", L("CLIP", "a"), Node.of("OR", L("CLIP", "b"), Node.of("SEQ", L("CLIP", "c"), L("CLIP", "d"))))
    config = TreeRules()
    s = np_seq(c, d)
    np.testing.assert_allclose(values(evaluate(df, tree, config)), a * (b + s - b * s), atol=1e-12)
    s = rescaled(np_seq(rescaled(c), rescaled(d)))
    o = rescaled(rescaled(b) + s - rescaled(b) * s)
    np.testing.assert_allclose(values(evaluate(df, tree, config, mode="rescaled")), rescaled(a) * o, atol=1e-12)
    np.testing.assert_allclose(values(compose(df, tree, config)), rescaled(a) * o, atol=1e-12)
    either = Node.of("OR", L("CLIP", "a"), L("CLIP", "b"))
    x, y = rescaled(a, 0, 1), rescaled(b, 0, 1)
    np.testing.assert_allclose(values(evaluate(df, either, config, mode="restandardized")), x + y - x * y, atol=1e-12)
    np.testing.assert_allclose(values(evaluate(df, L("CLIP", "a"), config, mode="rescaled")), a)
    np.testing.assert_allclose(values(compose(df, either, TreeRules(join="additive"))), (a + b) / 2)
    np.testing.assert_allclose(values(compose(df, either, TreeRules(join="multiplicative"))), a * b)
    with pytest.raises(MissingLeaf):
        evaluate(wide(spark, a), either, config)
    with pytest.raises(ValueError):
        compose(df, either, TreeRules(join="nope"))


def test_evaluation_needs_one_exchange(spark):
    signals = long(spark, [("a", CURVE), ("b", CURVE[::-1])]).repartition("video_id")
    tree = Node.of("AND", L("CLIP", "a"), L("CLIP", "b"))
    rows = smooth_by_expert(normalize_joint(signals), SignalRules(), 1.0, [*KEYS, "node_id"])
    out = compose(pivot(rows, [0, 1]), tree, TreeRules())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_score_ranked():
    assert ScoreRanked().choose(np.array([0.1, 0.9, 0.3, 0.7, 0.5]), 3)[0] == [1, 3, 4]
    assert ScoreRanked().choose(np.array([0.5, 0.3, 0.8]), 10)[0] == [2, 0, 1]
    assert ScoreRanked(min_gap=2).choose(np.array([0.1, 0.9, 0.85, 0.8, 0.1, 0.7, 0.1]), 3)[0] == [1, 3, 5]
    assert ScoreRanked(max_per_window=1, window_seconds=3).choose(np.array([0.9, 0.8, 0.7, 0.6, 0.5]), 5)[0] == [0, 3]
    assert ScoreRanked().choose(np.full(4, 0.5), 2)[0] == [3, 2]


def test_find_peaks():
    assert find_peaks(np.array([0, 1, 0, 2, 2, 2, 0, 3])).tolist() == [1, 4]
    assert find_peaks(np.array([0, 1, 0, 2, 0, 1.5, 0.0]), distance=3).tolist() == [3]
    assert find_peaks(np.array([0, 1, 0.9, 2, 0.0]), prominence=0.5).tolist() == [3]
    assert find_peaks(np.array([1.0, 2.0])).tolist() == []


def test_peaks_and_spread():
    x = np.zeros(100)
    for at, high in ((20, 1.0), (50, 0.8), (80, 0.6)):
        x[at] = high
    got, phase = PeaksAndSpread().choose(x, 16)
    assert got[:3] == [20, 50, 80] and phase[0] == "peak" and len(set(got)) == 16
    assert PeaksAndSpread().choose(x, 5)[0][:3] == [20, 50, 80]
    assert len(PeaksAndSpread().choose(np.array([0, 1, 0, 0, 0.0]), 3)[0]) == 3
    assert PeaksAndSpread().choose(x, 0)[0] == []
    with pytest.raises(ValueError):
        create_strategy(mode="nope")


def test_select_matches_its_strategy_on_each_timeline(spark):
    curves = {v: RNG.random(60) for v in ("x", "y")}
    df = spark.createDataFrame(pd.DataFrame([{"video_id": v, "qid": "q", "frame_idx": i, "score": s} for v, c in curves.items() for i, s in enumerate(c)]))
    for strategy in (ScoreRanked(), ScoreRanked(min_gap=3), PeaksAndSpread()):
        got = select(df, 16, strategy).toPandas().sort_values("rank")
        for v, c in curves.items():
            assert got[got.video_id == v].frame_idx.tolist() == strategy.choose(c.round(12), 16)[0]
