from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuesift.pipeline import FrameSelector, Question
from cuesift.plans.tree import Node
from cuesift.sources.features import CommitConflict, FeatureLookup, FeatureStore


@pytest.fixture
def store(spark, tmp_path):
    return FeatureStore(spark, f"file://{tmp_path}/f", buckets=4)


def videos(spark, *names):
    return spark.createDataFrame([(n, f"/{n}.mp4") for n in names], "video_id string, path string")


def said(spark, *rows):
    return spark.createDataFrame([(v, i, float(i), i + 1.0, text) for v, i, text in rows], "video_id string, seg_idx int, start double, end double, text string")


def texts(df):
    return sorted((r.video_id, r.seg_idx, r.text) for r in df.collect())


def test_a_video_without_rows_is_done(spark, store):
    calls = []

    def extract(some):
        calls.append(sorted(r.video_id for r in some.collect()))
        return said(spark, ("a", 0, "hi"), ("a", 1, "ho"), ("x", 0, "of no video"))

    both = videos(spark, "a", "b")
    assert texts(store.get("asr", both, 1.0, extract)) == [("a", 0, "hi"), ("a", 1, "ho")]
    store.get("asr", both, 1.0, extract)
    assert calls == [["a", "b"]] and store.version("asr") == 1
    assert {r.video_id: (r.asr, r.ocr) for r in store.status(both, 1.0).collect()} == {"a": (True, False), "b": (True, False)}
    assert {r.video_id: r.rows for r in store.manifest("asr").collect()} == {"a": 2, "b": 0}
    # nothing but videos without rows
    store.save("asr", said(spark, ("z", 0, "")).limit(0), videos(spark, "c"), 1.0)
    assert texts(store.load("asr")) == [("a", 0, "hi"), ("a", 1, "ho")] and not store.missing("asr", videos(spark, "c"), 1.0).take(1)
    assert [r.video_id for r in store.missing("asr", videos(spark, "c"), 2.0).collect()] == ["c"]


def test_versions_replace_keys_and_stay_readable(spark, store):
    store.save("asr", said(spark, ("a", 0, "old"), ("b", 0, "b")), videos(spark, "a", "b"), 1.0)
    store.save("asr", said(spark, ("a", 0, "new"), ("a", 1, "more")), videos(spark, "a"), 1.0)
    now = [("a", 0, "new"), ("a", 1, "more"), ("b", 0, "b")]
    assert texts(store.load("asr")) == now and texts(store.load("asr", version=1)) == [("a", 0, "old"), ("b", 0, "b")]
    assert texts(store.load("asr", videos(spark, "b", "none"), 1.0)) == [("b", 0, "b")]
    store.save("asr", said(spark, ("a", 0, "x")).limit(0), videos(spark, "a"), 1.0)
    assert texts(store.load("asr")) == [("b", 0, "b")]
    assert store.compact("asr") == 4 and len(store.commits("asr")) == 1 and texts(store.load("asr")) == [("b", 0, "b")]
    assert {r.video_id: r.rows for r in store.manifest("asr").collect()} == {"a": 0, "b": 1}
    assert store.vacuum("asr") == 6 and texts(store.load("asr")) == [("b", 0, "b")]
    assert store.load("clip").count() == 0 and store.version("clip") == 0


def test_what_isnt_committed_isnt_there(spark, store, tmp_path):
    store.save("asr", said(spark, ("a", 0, "a")), videos(spark, "a"), 1.0)
    keys = store._keyed(videos(spark, "b"), 1.0)
    snapshot, rows = store._write("asr", said(spark, ("b", 0, "b")).join(keys, "video_id"), keys)  # a writer that dies here
    (tmp_path / "f" / "asr" / "commits" / "000000000002").touch()  # or here
    assert texts(store.load("asr")) == [("a", 0, "a")] and not store.status(videos(spark, "b"), 1.0).first()["asr"]
    with pytest.raises(CommitConflict):
        store._commit("asr", snapshot, rows, base=True, after=1)
    assert store._commit("asr", snapshot, rows) == 3 and texts(store.load("asr")) == [("a", 0, "a"), ("b", 0, "b")]


def test_held_rows_follow_the_version(spark, store):
    store.save("asr", said(spark, ("a", 0, "a")), videos(spark, "a"), 1.0)
    first = store.hold("asr")
    assert store.hold("asr") is first and first.is_cached
    store.save("asr", said(spark, ("b", 0, "b")), videos(spark, "b"), 1.0)
    assert texts(store.hold("asr")) == [("a", 0, "a"), ("b", 0, "b")] and not first.is_cached
    store.release()
    assert not store._held


def vectors(spark, rows):
    return spark.createDataFrame(rows, "video_id string, frame_idx int, embedding array<float>")


@pytest.mark.parametrize("hold", [False, True])
def test_selector_takes_features_by_tier(spark, store, hold):
    calls = []
    table = vectors(spark, [(v, i, [1.0, 0.0] if i == at else [0.0, 1.0]) for v, at in (("a", 3), ("b", 7)) for i in range(10)])

    def extract(some):
        calls.append(sorted(r.video_id for r in some.collect()))
        return table.join(some.select("video_id"), "video_id", "left_semi")

    both = videos(spark, "a", "b")
    grid = table.select("video_id", "frame_idx")
    lookup = FeatureLookup(store, {"clip": extract}, hold=hold)
    lookup.prepare("clip", both.where("video_id = 'a'"), 1.0)
    tree = Node.leaf("CLIP", "dog")
    given = {"CLIP": {"queries": {"dog": [1.0, 0.0]}}}
    best = lambda qs: {(r.video_id, r.qid): r.frame_idx for r in FrameSelector().select_stored(both, grid, qs, lookup, given, 1).collect()}
    assert best([Question("q", tree, "a")]) == {("a", "q"): 3} and calls == [["a"]]
    assert best([Question("q", tree)]) == {("a", "q"): 3, ("b", "q"): 7} and calls == [["a"], ["b"]]
    assert best([Question("q", tree), Question("p", tree, "b")]) == {("a", "q"): 3, ("b", "q"): 7, ("b", "p"): 7} and len(calls) == 2
    assert {(r.video_id, r.feature): r.tier for r in lookup.report(both, 1.0).collect() if r.feature in ("clip", "asr")} == {(v, f): t for v in "ab" for f, t in (("clip", "memory" if hold else "store"), ("asr", "absent"))}
    store.release()


def test_vectors_are_fitted_and_wrong_lengths_extracted_again(spark, store):
    both = videos(spark, "a", "b", "c")
    store.save("clip", vectors(spark, [("a", i, [float(i), 1.0]) for i in range(5)] + [("b", i, [1.0]) for i in range(3)] + [("c", 0, [9.0, 9.0])]), both, 1.0)
    grid = spark.createDataFrame([(v, i) for v in "abc" for i in range(3)], "video_id string, frame_idx int")
    lookup = FeatureLookup(store, {"clip": lambda some: vectors(spark, [("b", 0, [7.0, 7.0])])}, dims={"clip": 2})
    rows = lookup.features(["CLIP", "OVD"], both, grid, 1.0)["CLIP"]["frames"].collect()
    assert sorted((r.video_id, r.frame_idx, *r.embedding) for r in rows) == [("a", 0, 2.0, 1.0), ("a", 1, 3.0, 1.0), ("a", 2, 4.0, 1.0), ("b", 0, 7.0, 7.0), ("c", 0, 9.0, 9.0)]


def test_text_and_speech_from_the_store(spark, store):
    one = videos(spark, "a")
    ocr = spark.createDataFrame([("a", 1, [("EXIT", 0.9), ("x", 0.1)])], "video_id string, frame_idx int, detections array<struct<text string, conf double>>")
    lookup = FeatureLookup(store, {"ocr": lambda some: ocr, "asr": lambda some: said(spark, ("a", 4, "go left"))})
    grid = spark.range(6).select(F.lit("a").alias("video_id"), F.col("id").cast("int").alias("frame_idx"))
    tree = Node.of("OR", Node.leaf("OCR", "exit"), Node.leaf("ASR", "left"))
    got = FrameSelector().select_stored(one, grid, [Question("q", tree)], lookup, k=6).collect()
    assert {r.frame_idx for r in got} == set(range(6)) and len({r.score for r in got}) > 1
