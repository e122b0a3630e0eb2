from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesift.functions import text as T
from cuesift.operators import scorers as S
from cuesift.pipeline import FrameSelector, Question, results, single
from cuesift.plans.compiler import MissingLeaf
from cuesift.plans.parsing import StaticParser
from cuesift.plans.tree import Node
from cuesift.sources import video
from cuesift.sources.features import FeatureStore
from cuesift.sources.text import parse_srt, read_questions, read_srt, subtitle_prompt
from cuesift.streaming.arrivals import select_on_end

SRT = "1\r\n00:00:01,000 --> 00:00:02,500\r\n<font color='white'>Hello\r\nthere</font>\r\n\r\n2\r\n00:01:00.000 --> 01:00:00,250\r\n\r\n\r\n3\r\n00:00:03,000 --> 00:00:04,000\r\n[Music]\r\n"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similarity(spark):
    rng = random.Random(3)
    words = ["", "a", "été", "etc", *["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(20)]]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", T.similarity(F.col("a"), F.col("b")).alias("s"), T.similarity(F.col("a"), F.col("b"), 0.0).alias("z"))
    for a, b, s, z in df.collect():
        expect = 1.0 if a == b else 0.0 if not a or not b else 1 - lev(a, b) / max(len(a), len(b))
        assert s == pytest.approx(expect) and z == pytest.approx(0.0 if not a and not b else expect)


def test_line_match_and_variations(spark):
    lines = F.array(F.lit(" Stop  sign "), F.lit("exit"))
    assert one(spark, T.best_line_match(F.lit("SIGN"), lines)) == 1.0
    assert one(spark, T.best_line_match(F.lit("exot"), lines)) == 0.75
    assert one(spark, T.best_line_match(F.lit("x"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, T.best_line_match(F.lit(""), lines)) == 1.0
    for phrase, forms in (("dog", ["dog", "dogs"]), ("buses", ["buses", "bus"]), ("cats", ["cats", "cat"]), ("red car", ["red car", "red cars", "car", "cars"]), ("red cars", ["red cars", "red car", "cars"]), ("red car ", ["red car ", "red car s", "car", "cars"]), ("dog ", ["dog ", "dog s"]), (" ", [" ", " s"])):
        assert one(spark, T.variations(F.lit(phrase))) == forms


def test_speech_match(spark):
    m = lambda q, t: one(spark, T.short_match(F.lit(q), F.lit(t)))
    assert m("Hello", "say hello!") == 1.0 and m("", "x") == 0.0 and m("x", "") == 0.0
    assert m("helo", "say hello") == pytest.approx(0.8)
    assert m("helo wrld", "hello big world") == pytest.approx(0.8)
    assert m("zzzz", "hello") == 0.0
    # a query is parted at blanks alone: hyphens and letters beyond a-z stay in its words
    assert m("co-op", "a coop shop") == pytest.approx(0.8)
    assert m("naïve bayes", "naive bayes said") == pytest.approx(0.8)
    assert one(spark, T.long_match(F.lit("a b c"), F.lit("x a b c y"), F.lit(0.1))) == 1.0
    assert one(spark, T.long_match(F.lit("a b c"), F.lit("other"), F.lit(-0.4))) == 0.0
    assert one(spark, T.is_short(F.lit("two words"))) and not one(spark, T.is_short(F.lit("now three words")))


def test_times_and_key(spark):
    assert one(spark, T.timestamp(F.lit(3725.5))) == "01:02:05.500"
    assert one(spark, T.clock(F.lit(3725.9))) == "[01:02:05]"
    assert one(spark, T.seconds_of(F.lit("01:02:05,250"))) == 3725.25
    assert one(spark, T.cache_key(F.lit("/a.mp4"), F.lit(1.0))) == hashlib.sha256(b"/a.mp4:1.0").hexdigest()


def test_srt(spark, tmp_path):
    (tmp_path / "clip.srt").write_bytes(SRT.encode())
    rows = read_srt(spark, f"file://{tmp_path}/clip.srt").orderBy("start").collect()
    assert [(r.video_id, r.start, r.end, r.text) for r in rows] == [("clip", 1.0, 2.5, "Hello there"), ("clip", 3.0, 4.0, "[Music]")]
    assert parse_srt(spark.createDataFrame([("e", "")], "video_id string, srt string")).count() == 0
    prompt = subtitle_prompt(read_srt(spark, f"file://{tmp_path}/clip.srt")).first()["prompt"]
    assert prompt == "[00:00:01] Hello there\n[00:00:03] [Music]"


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"question_id": "1", "question": "Q?", "candidates": ["a", "b"], "answer_index": 1, "metadata": {"domain": "x"}}, indent=1))
    row = read_questions(spark, f"file://{tmp_path}").first()
    assert row.candidates == ["a", "b"] and row.metadata.domain == "x" and row.answer is None


def test_frames(spark):
    videos = spark.createDataFrame([("a", 30.0, 95), ("b", 0.5, 3), ("bad", 0.0, 10)], "video_id string, video_fps double, total_frames int")
    got = [(r.video_id, r.frame_idx, r.source_frame) for r in video.frame_grid(videos, 1.0, strict=False).orderBy("video_id", "frame_idx").collect()]
    assert got == [("a", 0, 0), ("a", 1, 30), ("a", 2, 60), ("a", 3, 90), ("b", 0, 0), ("b", 1, 1), ("b", 2, 2)]
    assert video.frame_grid(videos, 1.0, max_frames=2, strict=False).count() == 4
    at = video.frames_at(videos, spark.createDataFrame([("a", 2), ("a", 2), ("a", 9)], "video_id string, frame_idx int")).collect()
    assert [(r.frame_idx, r.source_frame) for r in at] == [(2, 60)]
    with pytest.raises(Exception, match="frame rate"):
        video.checked_videos(videos).collect()


def test_audio_windows(spark):
    frames = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("a", 9, 9.0), ("b", 0, 0.0)], "video_id string, frame_idx int, ts double")
    audio = spark.createDataFrame([("a", [float(i) for i in range(40)])], "video_id string, samples array<float>")
    got = {(r.video_id, r.frame_idx): r.chunk for r in video.audio_windows(frames, audio, 1.0, rate=20).collect()}
    assert len(got["a", 0]) == 15 and got["a", 1][0] == 5.0 and len(got["a", 1]) == 30
    assert got["a", 9] == [] and got["b", 0] == []


def test_windows_from_seconds_are_those_from_whole_sounds(spark):
    rng = np.random.default_rng(1)
    sounds = [("a", rng.random(95).tolist()), ("b", rng.random(20).tolist()), ("c", rng.random(3).tolist()), ("d", []), ("e", None)]
    audio = spark.createDataFrame(sounds, "video_id string, samples array<float>")
    frames = spark.createDataFrame([(v, i, i * 0.37) for v in "abcdef" for i in range(16)], "video_id string, frame_idx int, ts double")
    chunks = video.sound_chunks(audio, 20)
    assert chunks.agg(F.max(F.size("samples"))).first()[0] == 20 and chunks.count() == 7
    cut = lambda df: {(r.video_id, r.frame_idx): r.chunk for r in df.collect()}
    for fps, expansion in ((1.0, 0.5), (0.2, 0.5), (4.0, 0.0)):
        assert cut(video.chunked_windows(frames, chunks, fps, 20, expansion)) == cut(video.audio_windows(frames, audio, fps, 20, expansion))


def test_decoder_plugin(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    video.register_decoder("bytes", lambda content: [{"at": i, "value": b} for i, b in enumerate(content)])
    rows = video.decoded(spark, f"file://{tmp_path}", "bytes", "at int, value int").orderBy("at").collect()
    assert [r.value for r in rows] == [97, 98, 99]
    with pytest.raises(video.SourceError):
        video.decoded(spark, "x", "nope", "a int")


def grid(spark, n=6):
    return spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("frame_idx"))


def test_detections_have_one_owner(spark):
    rows = spark.createDataFrame([("v", 0, "cats", 0.9), ("v", 1, "cat", 0.4), ("v", 1, "cat", 0.6), ("v", 2, "cat", 0.0001)], "video_id string, frame_idx int, class string, conf double")
    got = {(r["query"], r.frame_idx): r.score for r in S.ovd_scores(grid(spark, 3), rows, ["cat", "cats"]).collect()}
    assert got == {("cat", 0): 0.9, ("cat", 1): 0.6, ("cat", 2): 0.0, ("cats", 0): 0.0, ("cats", 1): 0.0, ("cats", 2): 0.0}


def test_regular_and_irregular_segment_joins_agree(spark):
    rng = random.Random(1)
    rows = [("v", i, a := rng.uniform(0, 20), a + rng.uniform(0, 5), "t") for i in range(60)]
    segments = spark.createDataFrame(rows, "video_id string, seg_idx int, start double, end double, text string")
    for fps in (1.0, 2.0):
        n = 30
        frames = grid(spark, n).withColumn("ts", F.col("frame_idx") / fps)
        a = {(r.seg_idx, r.frame_idx): r.weight for r in S.segment_frames(segments, fps, F.lit(n)).collect()}
        b = {(r.seg_idx, r.frame_idx): r.weight for r in S.segment_frames_irregular(segments, frames, fps).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_asr_clap_ocr_scores(spark):
    segments = spark.createDataFrame([("v", 0, 1.0, 2.0, "hello world")], "video_id string, seg_idx int, start double, end double, text string")
    cosines = spark.createDataFrame([("v", 0, "a very long query", 0.7)], "video_id string, seg_idx int, query string, cosine double")
    got = {(r["query"], r.frame_idx): r.score for r in S.asr_scores(grid(spark, 4), segments, ["hello", "a very long query"], 1.0, cosines).collect()}
    assert [got["hello", i] for i in range(4)] == [0.0, 0.5, 0.5, 0.0] and got["a very long query", 1] == pytest.approx(0.35)
    frames = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, None)], "video_id string, frame_idx int, embedding array<float>")
    assert {r.frame_idx: r.score for r in S.clap_scores(frames, {"s": [1.0, 0.0]}).collect()} == {0: 1.0, 1: 0.5}
    texts = spark.createDataFrame([("v", 1, ["EXIT"])], "video_id string, frame_idx int, lines array<string>")
    assert {r.frame_idx: r.score for r in S.ocr_scores(grid(spark, 3), texts, ["exit"]).collect()} == {0: 0.0, 1: 1.0, 2: 0.0}
    words = spark.createDataFrame([("v", 0, 0, 1, "b", 0.5), ("v", 0, 0, 0, "a", 0.9), ("v", 0, 0, 2, " ", 0.1)], "video_id string, frame_idx int, line int, word_idx int, word string, conf double")
    assert S.ocr_lines(words).select("text", "conf").collect() == [("a b", 0.5)]


def test_templates(spark):
    v = S.template_vectors(lambda texts: [[3.0, 0.0], [0.0, 2.0]], "dog", ["a {}", "the {}"])
    assert v == pytest.approx([0.5**0.5] * 2)
    rows = spark.createDataFrame([("q", [3.0, 0.0]), ("q", [0.0, 2.0])], "query string, embedding array<double>")
    assert S.template_means(rows).first()["embedding"] == pytest.approx(v)


def test_feature_store(spark, tmp_path):
    store = FeatureStore(spark, f"file://{tmp_path}/f")
    videos = spark.createDataFrame([("a", "/a.mp4"), ("b", "/b.mp4")], "video_id string, path string")
    calls = []

    def extract(missing):
        calls.append(sorted(r.video_id for r in missing.collect()))
        return missing.select("video_id", F.lit(0).alias("seg_idx"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("hi").alias("text"))

    assert store.load("asr").count() == 0
    store.extract_features(videos.where("video_id = 'a'"), 1.0, {"asr": extract})
    status = {r.video_id: r.asr for r in store.extract_features(videos, 1.0, {"asr": extract}).collect()}
    assert calls == [["a"], ["b"]] and status == {"a": True, "b": True}
    assert store.load("asr", videos.where("video_id = 'b'"), 1.0).count() == 1 and store.hold("asr").count() == 2
    assert not store.status(videos, 2.0).first()["asr"]
    with pytest.raises(ValueError):
        store.load("nope")


def test_selector(spark):
    n = 60
    a, b = [0.1] * n, [0.1] * n
    for i in range(20, 30):
        a[i] = 0.9
    for i in range(24, 28):
        b[i] = 0.8
    frames = spark.createDataFrame([("v", i, [a[i] * 2 - 1, b[i] * 2 - 1]) for i in range(n)], "video_id string, frame_idx int, embedding array<double>")
    features = {"CLIP": {"frames": frames, "queries": {"a": [1.0, 0.0], "b": [0.0, 1.0]}}}
    tree = Node.of("AND", Node.leaf("CLIP", "a"), Node.leaf("CLIP", "b"))
    selector = FrameSelector(parser=StaticParser(tree))
    question = selector.parse("q1", "what?", ["x"])
    chosen = single(spark, selector, "v", n, question, features)
    rows = chosen.orderBy("rank").collect()
    assert len({r.frame_idx for r in rows}) == 16 and 22 <= rows[0].frame_idx <= 29
    truth = selector.truth(selector.scores(grid(spark, n), tree, features, 1.0), question, 1.0)
    out = results(chosen, truth, {"q1": tree}, 1.0).first()
    assert out.best_frame_idx == rows[0].frame_idx and out.num_frames == n and Node.from_json(out.tree) == tree and len(out.truth_curve) == n
    assert single(spark, selector, "v", n, question, features, k=0).count() == 0


def test_leaves_of_disabled_experts(spark):
    tree = Node.of("AND", Node.leaf("CLIP", "a"), Node.leaf("ASR", "b"))
    with pytest.raises(MissingLeaf):
        FrameSelector.preset("fast").bound(tree)
    assert FrameSelector.preset("fast", on_missing="drop").bound(tree) == Node.leaf("CLIP", "a")
    assert Question("q", tree).tree is tree


def test_streaming_selects_a_video_at_its_end(spark, tmp_path):
    for part in ("in", "frames", "out", "check"):
        (tmp_path / part).mkdir()
    rows = [{"video_id": "a", "frame_idx": i, "expert": "CLIP", "query": "q", "score": i / 10, "is_end": False} for i in range(5)]
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(r) for r in rows[:3]))
    top = lambda df: df.groupBy("video_id").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    at = {k: f"file://{tmp_path}/{k}" for k in ("in", "frames", "out", "check")}
    run = lambda: select_on_end(spark, at["in"], at["frames"], at["out"], at["check"], top).awaitTermination(60)
    run()
    assert not list((tmp_path / "out").iterdir())
    (tmp_path / "in/2.json").write_text("\n".join(json.dumps(r) for r in [*rows[3:], {"video_id": "a", "is_end": True}]))
    run()
    assert [(r.video_id, r.score, r.n) for r in spark.read.parquet(at["out"]).collect()] == [("a", 0.4, 5)]


def test_stream_with_missing_marks_and_late_frames(spark, tmp_path):
    top = lambda t: t.groupBy("video_id").agg(F.count("*").alias("n"))
    at = {x: f"file://{tmp_path}/{x}" for x in ("in", "frames", "out", "check")}
    (tmp_path / "in").mkdir()
    run = lambda: select_on_end(spark, at["in"], at["frames"], at["out"], at["check"], top).awaitTermination(60)
    frame = lambda v, i: {"video_id": v, "frame_idx": i, "expert": "CLIP", "query": "q", "score": 0.5}
    put = lambda n, rows: (tmp_path / f"in/{n}.json").write_text("\n".join(map(json.dumps, rows)))
    put(1, [frame("a", 0), {**frame("a", 1), "is_end": False}, frame("b", 0), {"video_id": "a", "is_end": True}])
    run()
    assert [tuple(r)[:2] for r in spark.read.parquet(at["out"]).collect()] == [("a", 2)]
    put(2, [frame("a", 2), {"video_id": "a", "is_end": True}, frame("b", 1), {"video_id": "b", "is_end": True}])
    run()
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(at["out"]).collect()) == [("a", 2), ("b", 2)]
    assert [(r.video_id, r.frame_idx) for r in spark.read.parquet(f"{at['out']}-late").collect()] == [("a", 2)]


def test_tables_of_trees(spark):
    from cuesift.plans import bulk

    leaf = Node.leaf("OVD", "a").to_dict()
    rows = [("good", json.dumps({"op": "RIGHT_AFTER", "children": [leaf] * 3})), ("bad", json.dumps({"op": "XOR", "children": [leaf]})), ("text", "{"), ("null", None)]
    trees = spark.createDataFrame(rows, "qid string, tree string").withColumn("tree", bulk.repaired("tree"))
    assert {r.qid for r in bulk.problems(trees).collect()} == {"bad", "text", "null"}
    got = bulk.flattened(trees.where("qid = 'good'")).orderBy("node_id").collect()
    assert [(r.node_id, r["query"], r.path) for r in got] == [(0, "a", "0.0"), (1, "a", "0.1.0"), (2, "a", "0.1.1")]


def test_selection_prompt_and_frames(spark):
    from cuesift.sources.text import encoded_frames, selection_prompt

    selected = spark.createDataFrame([("v", "q", 61.0), ("v", "q", 2.0)], "video_id string, qid string, ts double")
    segments = spark.createDataFrame([("v", 0, 1.0, 2.0, "hi")], "video_id string, seg_idx int, start double, end double, text string")
    questions = spark.createDataFrame([("q", "What?", ["x", "y"])], "qid string, question string, candidates array<string>")
    prompt = selection_prompt(selected, segments, questions).first()["prompt"]
    assert prompt == "Frames at: [00:00:02] [00:01:01]\n\nSubtitles:\n[00:00:01] hi\n\nQuestion: What?\n\nOptions:\nA. x\nB. y"
    assert encoded_frames(spark.createDataFrame([(1, bytearray(b"abc"))], "i int, image binary")).first()["image"] == "YWJj"


def test_bound_questions_are_answered_as_alone(spark):
    """Many questions of two shapes, each on its video, against one question at a time; templates are averaged."""
    from dataclasses import replace

    from cuesift.config import Settings
    from cuesift.pipeline import shape_of

    rng = random.Random(8)
    rows = [(v, i, [rng.gauss(0, 1) for _ in range(4)]) for v in "abc" for i in range(40)]
    frames = spark.createDataFrame([(v, i, [x / sum(y * y for y in e) ** 0.5 for x in e]) for v, i, e in rows], "video_id string, frame_idx int, embedding array<double>")
    unit = lambda t: [float(k == hash(t) % 4) or 0.1 for k in range(4)]
    features = {"CLIP": {"frames": frames, "embed": lambda texts: [unit(t) for t in texts]}}
    both, either = Node.of("AND", Node.leaf("CLIP", "x"), Node.leaf("CLIP", "y")), Node.of("OR", Node.leaf("CLIP", "z"), Node.leaf("CLIP", "x"))
    questions = [Question("1", both, "a"), Question("2", either, "b"), Question("3", both, "c"), Question("4", either, "a")]
    selector = FrameSelector(replace(Settings(), templates=("a photo of {}", "{} in a film")))
    assert shape_of(both) == "AND(.,.)" and shape_of(either) == "OR(.,.)"
    key = lambda r: (r.video_id, r.qid, r.rank, r.frame_idx, round(r.score, 9), r.phase)
    got = sorted(map(key, selector.select(frames.select("video_id", "frame_idx"), questions, features, 8).collect()))
    alone = []
    for q in questions:
        one = frames.where(F.col("video_id") == q.video_id)
        alone += map(key, selector.select(one.select("video_id", "frame_idx"), [Question(q.qid, q.tree)], {"CLIP": {**features["CLIP"], "frames": one}}, 8).collect())
    assert got == sorted(alone) and len(got) == 32
