from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesift.operators import blocks as B
from cuesift.operators.logic import faded, right_after, seq
from cuesift.operators.normalize import normalize
from cuesift.operators.smooth import kernel, smooth

KEYS = ["video_id"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for v, n, step in (("a", 200, 1), ("b", 37, 3), ("c", 1, 1), ("d", 64, 7)):
        out += [(v, int(i) * step + (5 if v == "b" else 0), *map(float, rng.random(3).round(2))) for i in range(n)]
    return spark.createDataFrame(out, "video_id string, frame_idx int, x double, y double, z double").repartition(5).cache()


def values(df, *columns):
    return {(r["video_id"], r["frame_idx"]): tuple(r[c] for c in columns) for r in df.collect()}


def alike(got, wanted):
    assert got.keys() == wanted.keys()
    for k in got:
        assert got[k] == pytest.approx(wanted[k], rel=1e-9, abs=1e-12), k


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_blocks_give_what_windows_give(rows, block):
    alike(values(B.seq_blocks(rows, ["x", "y"], KEYS, "s", block=block), "s", "x", "z"), values(seq(rows, ["x", "y"], KEYS, "s"), "s", "x", "z"))
    alike(values(B.seq_blocks(rows, ["x", "y", "z"], KEYS, "x", block=block), "x", "y"), values(seq(rows, ["x", "y", "z"], KEYS, "_t").drop("x").withColumnRenamed("_t", "x"), "x", "y"))
    for sigma in (0.1, 0.5, 2.0, 9.0):
        alike(values(B.smooth_blocks(rows, sigma, KEYS, "x", "s", block=block), "s", "x", "y"), values(smooth(rows, sigma, KEYS, "x", "s"), "s", "x", "y"))
    for kappa in (2.0, 0.05):
        alike(values(B.right_after_blocks(rows, "x", "y", KEYS, "s", kappa, block=block), "s", "z"), values(right_after(rows, "x", "y", KEYS, "s", kappa), "s", "z"))


@pytest.mark.parametrize("few", [4, 1 << 14])
def test_medians_are_exact(spark, rows, few):
    rng = np.random.default_rng(2)
    groups = {"even": rng.random(1000), "odd": rng.standard_normal(1001) * 1e6, "ties": rng.integers(0, 3, 500).astype(float), "same": np.full(99, 2.5), "wide": 10.0 ** rng.uniform(-30, 30, 600), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "huge": np.array([-1.7e308, 1.7e308] * 20 + [1.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("none", None)], "g string, v double")
    got = {r.g: r.median for r in B.exact_medians(df, ["g"], "v", few, 16).collect()}
    assert got.pop("none") is None and got == {k: float(np.median(v)) for k, v in groups.items()}
    assert B.exact_medians(df, [], "v", few, 16).first()["median"] == float(np.median(np.concatenate(list(groups.values()))))
    assert B.exact_medians(df.limit(0), ["g"], "v").collect() == []


@pytest.mark.parametrize("method", ["robust", "minmax", "zscore"])
def test_normalised_blocks(rows, method):
    alike(values(B.normalize_blocks(rows, KEYS, method, "x", "s"), "s", "x"), values(normalize(rows, KEYS, method, "x", "s"), "s", "x"))
    with pytest.raises(ValueError):
        B.normalize_blocks(rows, KEYS, "nope", "x")


def test_one_long_timeline_is_spread(spark):
    """Two million frames of one video: no task has more than a few blocks, and the rows are those of NumPy."""
    n, block = 2_000_000, 1 << 15
    df = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_idx"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(991)).cast("double").alias("y"))
    table = df.select("x", "y").toPandas()
    x, y = table["x"].to_numpy(), table["y"].to_numpy()
    w = np.array(kernel(3.0))
    smoothed = np.convolve(np.concatenate([np.full(12, x[0]), x, np.full(12, x[-1])]), w, "valid")
    before = np.concatenate([[0], np.maximum.accumulate(x)[:-1]])
    after = np.concatenate([np.maximum.accumulate(y[::-1])[:-1][::-1], [0]])
    decayed = np.maximum(y * faded(x, 0.02), x * faded(y[::-1], 0.02)[::-1])
    for got, wanted in (
        (B.smooth_blocks(df, 3.0, KEYS, "x", "s", block=block, dense=True), smoothed),
        (B.seq_blocks(df, ["x", "y"], KEYS, "s", block=block, dense=True), np.maximum(x * after, y * before)),
        (B.right_after_blocks(df, "x", "y", KEYS, "s", 0.02, block=block, dense=True), decayed),
    ):
        found = got.select("frame_idx", "s").toPandas().sort_values("frame_idx")["s"].to_numpy()
        assert len(found) == n and np.allclose(found, wanted, rtol=1e-9)
    size = B.numbered(df, KEYS, block=block, dense=True).groupBy("_block").count().agg(F.max("count")).first()[0]
    assert size == block


def test_selector_by_blocks(spark):
    """Trees of every operator, repeated queries and several widths give the curves of the windows."""
    from cuesift.config import Settings, TreeRules
    from cuesift.pipeline import FrameSelector, Question
    from cuesift.plans.tree import Node

    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(v, i, rng.standard_normal(3).tolist()) for v, n in (("a", 50), ("b", 23)) for i in range(n)], "video_id string, frame_idx int, embedding array<double>")
    queries = {q: rng.standard_normal(3).tolist() for q in ("p", "q", "r")}
    features = {e: {"frames": vectors, "queries": queries} for e in ("CLIP", "CLAP")}
    leaf = Node.leaf
    trees = [
        Node.of("SEQ", leaf("CLIP", "p"), leaf("CLAP", "q"), leaf("CLIP", "r")),
        Node.of("AND", Node.of("RIGHT_AFTER", leaf("CLIP", "p"), leaf("CLAP", "p")), Node.of("OR", leaf("CLIP", "p"), leaf("CLIP", "q"))),
    ]
    for tree in trees:
        curves = []
        for block in (None, 8):
            selector, question = FrameSelector(Settings(tree=TreeRules(block=block, decay=0.2))), Question("q", tree)
            curves.append(values(selector.truth(selector.scores(vectors.select("video_id", "frame_idx"), tree, features, 1.0), question, 1.0), "score"))
        alike(*curves)
