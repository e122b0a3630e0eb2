from __future__ import annotations

import io
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesift.operators.extract import extract
from cuesift.sources import media
from cuesift.sources.video import frame_grid


def wav(samples, rate, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        top = (1 << 8 * width - 1) - 1
        f.writeframes(b"".join(int(x * top).to_bytes(width, "little", signed=True) if width > 1 else struct.pack("B", int(x * 127) + 128) for x in samples))
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_widths(width):
    x = [math.sin(i / 9) for i in range(400)]
    assert np.abs(media.wav_samples(wav(x, 16_000, 1, width)) - x).max() < 0.02


def test_wav_channels_and_rates():
    left_right = [v for i in range(100) for v in (0.5, -0.5 if i % 2 else 0.5)]
    assert media.wav_samples(wav(left_right, 16_000, 2)).tolist() == pytest.approx([0.5, 0.0] * 50, abs=1e-3)
    slow = media.wav_samples(wav([i / 1000 for i in range(800)], 8_000))
    assert len(slow) == 1600 and slow[801] == pytest.approx(0.4005, abs=1e-3)


def y4m(frames, colour="420jpeg"):
    h, w = frames[0].shape
    chroma = {"420jpeg": ((w + 1) // 2) * ((h + 1) // 2), "mono": 0}[colour]
    return f"YUV4MPEG2 W{w} H{h} F30000:1001 Ip C{colour}\n".encode() + b"".join(b"FRAME\n" + f.tobytes() + bytes(2 * chroma) for f in frames)


def test_tables_of_media_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    frames = [rng.integers(0, 256, (5, 7), dtype=np.uint8) for _ in range(70)]
    (tmp_path / "a.y4m").write_bytes(y4m(frames))
    (tmp_path / "m.y4m").write_bytes(y4m(frames[:3], "mono")[:-2])  # the last frame is cut short
    (tmp_path / "a.wav").write_bytes(wav([0.25] * 8_000, 16_000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    (tmp_path / "none.wav").write_bytes(wav([], 16_000))
    at = f"file://{tmp_path}"
    videos = media.video_table(spark, at, "*.y4m")
    got = {r.path.rsplit("/", 1)[1]: r for r in videos.collect()}
    assert (got["a.y4m"].width, got["a.y4m"].height, got["a.y4m"].total_frames) == (7, 5, 70) and got["m.y4m"].total_frames == 2
    assert got["a.y4m"].duration == pytest.approx(70 * 1001 / 30000)
    sounds = {r.path.rsplit("/", 1)[1]: r for r in media.full_audio(spark, at, "*.wav").collect()}
    assert len(sounds["a.wav"].samples) == 8_000 and sounds["a.wav"].duration == 0.5 and sounds["a.wav"].error is None
    assert sounds["bad.wav"].samples is None and sounds["bad.wav"].error and sounds["none.wav"].error == "no sound"
    assert {r.duration for r in media.audio_duration(spark, at, "*.wav").collect()} == {0.5, None}
    with pytest.raises(Exception, match="bad.wav"):
        media.full_audio(spark, at, "bad.wav", strict=True).collect()
    (tmp_path / "long.wav").write_bytes(wav([0.5] * 40_000, 16_000))
    seconds = sorted((r.path.rsplit("/", 1)[1], r.second, len(r.samples)) for r in media.audio_seconds(spark, at, "*.wav").collect() if r.samples is not None)
    assert seconds == [("a.wav", 0, 8_000), ("long.wav", 0, 16_000), ("long.wav", 1, 16_000), ("long.wav", 2, 8_000)]
    assert sorted(r.error for r in media.audio_seconds(spark, at, "none.wav").collect()) == ["no sound"]
    with pytest.raises(Exception, match="no decoder"):
        media.video_table(spark, at, "*.wav").collect()
    grid = frame_grid(videos.withColumn("video_id", F.col("path")), 2.0).withColumnRenamed("video_id", "path")
    pictures = {(r.path[-5:], r.frame_idx): r for r in media.luma_frames(spark, at, grid).collect()}
    for r in grid.collect():
        k = r.source_frame
        assert bytes(pictures[r.path[-5:], r.frame_idx].luma) == frames[k].tobytes()
    assert len(pictures) == grid.count() == 6


def test_grid_can_be_strict(spark):
    videos = spark.createDataFrame([("a", 10.0, 30), ("b", 0.0, 30)], "video_id string, video_fps double, total_frames int")
    assert {r.video_id for r in frame_grid(videos, 1.0, strict=False).collect()} == {"a"}
    with pytest.raises(Exception, match="without frames"):
        frame_grid(videos, 1.0).collect()


def test_models_run_in_batches(spark):
    rows = spark.range(10).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("frame_idx"), (F.col("id") * 2).alias("x"))

    def load():
        return {"made": 0}

    def run(model, part):
        assert len(part) <= 3
        model["made"] += 1
        return [[float(x), float(len(part))] for x in part["x"]]

    got = extract(rows.coalesce(1), "doubling", load, run, ["video_id", "frame_idx"], "embedding array<float>", 3, 2).collect()
    assert sorted((r.frame_idx, r.embedding[0]) for r in got) == [(i, 2.0 * i) for i in range(10)]
    assert extract(rows.where("false"), "never", lambda: 1 / 0, run, ["frame_idx"], "embedding array<float>").count() == 0
    with pytest.raises(Exception, match="length 5"):
        extract(rows, "doubling", load, run, ["frame_idx"], "embedding array<float>", 3, 5).collect()


def test_models_by_preset_and_profile(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    from cuesift.config import EmbeddingPreset, register_embedding_preset
    from cuesift.operators.extract import embed

    register_embedding_preset(EmbeddingPreset("tiny", "T", None, 2, 8, 4))
    rows = spark.range(10).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("frame_idx"))

    def run(model, part):
        assert len(part) <= 4 and model == "T8"
        return [[float(i), 1.0] for i in part["frame_idx"]]

    got = embed(rows, "tiny", lambda p: f"{p.model}{p.image_size}", run).collect()
    assert sorted(r.embedding[0] for r in got) == [float(i) for i in range(10)]
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    plan = embed(rows, "tiny", lambda p: p, run, profile=profile, barrier=True)._jdf.queryExecution().logical()
    assert plan.isBarrier() and plan.profile().isDefined()
    with pytest.raises(ValueError):
        embed(rows, "unheard of", lambda p: p, run)
