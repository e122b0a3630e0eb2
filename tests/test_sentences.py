"""Spoken queries of several words by sentence vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesift.config import Settings
from cuesift.operators.matrix import with_cosines
from cuesift.operators.scorers import asr_scores, long_queries, sentence_vectors
from cuesift.pipeline import FrameSelector, Question
from cuesift.plans.tree import Node

TEXTS = ["we cut the onion now", "Then fry it", "then FRY it all", "", None, "we cut the onion now"]
QUERIES = ["fry", "cut the onion", "how to fry eggs"]


def vector(text):
    return [float(x) for x in np.random.default_rng(sum(map(ord, text.lower()))).standard_normal(6)]


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


@pytest.fixture()
def segments(spark):
    rows = [("v", i, float(i), i + 1.0, t, vector(t or "") if t and i != 2 else None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "video_id string, seg_idx int, start double, end double, text string, embedding array<double>")


@pytest.fixture()
def grid(spark):
    return spark.range(6).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("frame_idx"))


def expected(query, own):
    best = np.zeros(6)
    for i, text in enumerate(TEXTS):
        if not text:
            continue
        score = 1.0 if query in text.lower() else max(0.0, cosine(vector(text), vector(query))) if own or i != 2 else 0.0
        for f in range(6):
            best[f] = max(best[f], score * max(0.0, min(i + 1, f + 0.5) - max(i, f - 0.5)))
    return best


def test_segments_and_sentences(spark, grid, segments):
    vectors = {q: vector(q) for q in QUERIES}
    loads = spark.sparkContext.accumulator(0)
    known = {t: vector(t) for t in TEXTS if t}

    def run(model, texts):
        loads.add(len(texts))
        return [known[t] for t in texts]

    sentences = sentence_vectors(segments, lambda: None, run, 2, 6)
    assert {r.text for r in sentences.collect()} == {t for t in TEXTS if t} and loads.value == 3
    for options in ({}, {"sentences": sentences}):
        got = asr_scores(grid, segments, QUERIES, vectors=vectors, **options).collect()
        for q in QUERIES[1:]:
            found = [r.score for r in sorted(got, key=lambda r: r.frame_idx) if r.query == q]
            assert found == pytest.approx(expected(q, bool(options)).tolist(), abs=1e-6)
    assert long_queries([*QUERIES, "", "  two words "]) == QUERIES[1:]


def test_without_vectors_containment_counts(spark, grid, segments):
    for options in ({}, {"vectors": {}}, {"vectors": {"how to fry eggs": vector("x")}}):
        got = {(r.query, r.frame_idx): r.score for r in asr_scores(grid, segments.drop("embedding"), QUERIES, **options).collect()}
        assert got["cut the onion", 0] == 0.5 and max(v for (q, _), v in got.items() if q == "how to fry eggs") == 0
    assert asr_scores(grid, segments.where("false"), QUERIES, vectors={q: vector(q) for q in QUERIES}).where("score > 0").count() == 0


def test_cosines_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, []), (7, [-3.0, 0.0])]
    table = spark.createDataFrame(rows, "i int, embedding array<float>")
    got = {r.i: r.cosines for r in with_cosines(table, [[2.0, 0.0], [0.0, 0.0], [5.0]]).collect()}
    assert got == {0: [1, 0, 0], 1: [0, 0, 0], 2: [0, 0, 0], 3: [0, 0, 1], 4: [0, 0, 0], 5: [0, 0, 0], 6: [0, 0, 0], 7: [-1, 0, 0]}
    assert with_cosines(table, []).first().cosines == []


def test_selector_embeds_long_queries(spark, grid, segments):
    asked = []

    def embed(texts):
        asked.extend(texts)
        return [vector(t) for t in texts]

    tree = Node.of("OR", Node.leaf("ASR", "fry"), Node.leaf("ASR", "how to fry eggs"))
    selector = FrameSelector(Settings())
    got = selector.scores(grid, tree, {"ASR": {"segments": segments, "embed": embed}}, 1.0).where("query = 'how to fry eggs'")
    assert [r.score for r in got.orderBy("frame_idx").collect()] == pytest.approx(expected("how to fry eggs", False).tolist(), abs=1e-6)
    assert asked == ["how to fry eggs"] and selector.select(grid, [Question("q", tree)], {"ASR": {"segments": segments, "embed": embed}}, 2).count() == 2
