"""Frame grids, frame and audio windows, and pluggable decoders of media files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A video that can't be sampled."""


def checked_videos(videos: DataFrame) -> DataFrame:
    """``videos`` (video_id, path, video_fps, total_frames, ...) with duration; a row without a rate or frames fails."""
    bad = F.concat(F.lit("video without frames or frame rate: "), F.col("video_id").cast("string"))
    ok = (F.col("video_fps") > 0) & (F.col("total_frames") > 0)
    return videos.withColumn("duration", F.when(ok, F.col("total_frames") / F.col("video_fps")).otherwise(F.raise_error(bad).cast("double")))


def frame_grid(videos: DataFrame, fps: float = 1.0, max_frames: int | None = None, strict: bool = True) -> DataFrame:
    """Sampled frames: video_id, frame_idx (0, 1, ...), source_frame, ts.

    The k-th kept frame is the first at or after k intervals of max(1, video_fps / fps) source frames. A video
    without a rate or frames fails; without ``strict`` it has no frames.
    """
    videos = checked_videos(videos).where("duration is not null") if strict else videos
    step = F.greatest(F.lit(1.0), F.col("video_fps") / fps)
    n = F.ceil(F.col("total_frames") / step)
    n = F.least(n, F.lit(max_frames)) if max_frames is not None else n
    rows = videos.where((F.col("video_fps") > 0) & (F.col("total_frames") > 0)).withColumn("_step", step).withColumn("_n", n.cast("int")).where("_n > 0")
    rows = rows.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumn("source_frame", F.ceil(F.col("frame_idx") * F.col("_step")).cast("long")).where("source_frame < total_frames")
    return rows.select("video_id", "frame_idx", "source_frame", (F.col("source_frame") / F.col("video_fps")).alias("ts"))


def frames_at(videos: DataFrame, indices: DataFrame, fps: float = 1.0) -> DataFrame:
    """Source frames of given indices (video_id, frame_idx), each once: floor(index * interval); those past the end are left out."""
    rows = indices.select("video_id", "frame_idx").distinct().join(videos, "video_id")
    rows = rows.withColumn("source_frame", F.floor(F.col("frame_idx") * F.greatest(F.lit(1.0), F.col("video_fps") / fps)))
    return rows.where("source_frame < total_frames").select("video_id", "frame_idx", "source_frame", (F.col("source_frame") / F.col("video_fps")).alias("ts"))


def audio_bounds(ts: Column, fps: float, samples: Column, rate: int = 16_000, expansion: float = 0.5) -> tuple[Column, Column]:
    """First and past-the-last sample of the window around a frame: (1 + expansion) / fps seconds, within the sound."""
    half = (1.0 / fps) * (1 + expansion) / 2
    start = F.least(F.floor(F.greatest(F.lit(0.0), ts - half) * rate), samples)
    end = F.least(F.floor((ts + half) * rate), samples)
    return start.cast("long"), end.cast("long")


def audio_windows(frames: DataFrame, audio: DataFrame, fps: float, rate: int = 16_000, expansion: float = 0.5) -> DataFrame:
    """(video_id, frame_idx, ts) and (video_id, samples array) -> (video_id, frame_idx, chunk); empty without sound."""
    rows = frames.join(audio, "video_id", "left")
    start, end = audio_bounds(F.col("ts"), fps, F.coalesce(F.size("samples"), F.lit(0)), rate, expansion)
    empty = F.array().cast("array<float>")
    rows = rows.withColumn("_a", start).withColumn("_b", end)
    chunk = F.when(F.col("samples").isNull() | (F.col("_a") >= F.col("_b")), empty).otherwise(F.slice("samples", (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")))
    return rows.select("video_id", "frame_idx", chunk.alias("chunk"))


def sound_chunks(audio: DataFrame, rate: int = 16_000) -> DataFrame:
    """(video_id, samples array) -> (video_id, second, samples): a row for each second of sound."""
    seconds = F.ceil(F.size("samples") / rate).cast("int")
    rows = audio.where(F.size("samples") > 0).select("video_id", "samples", F.explode(F.sequence(F.lit(0), seconds - 1)).alias("second"))
    return rows.select("video_id", "second", F.slice("samples", F.col("second") * rate + 1, F.lit(rate)).alias("samples"))


def chunked_windows(frames: DataFrame, chunks: DataFrame, fps: float, rate: int = 16_000, expansion: float = 0.5) -> DataFrame:
    """(video_id, frame_idx, ts) and seconds of sound (video_id, second, samples) -> (video_id, frame_idx, chunk).

    As ``audio_windows``, but no row holds a whole sound: a frame's window says which seconds it needs, they are joined by
    number, cut, and put together in order. Frames without sound have an empty chunk.
    """
    start, end = audio_bounds(F.col("ts"), fps, F.lit(1 << 62), rate, expansion)
    rows = frames.select("video_id", "frame_idx", start.alias("_a"), end.alias("_b"))
    needed = F.when(F.col("_b") > F.col("_a"), F.sequence(F.floor(F.col("_a") / rate), F.floor((F.col("_b") - 1) / rate)))
    rows = rows.withColumn("second", F.explode_outer(needed)).join(chunks.select("video_id", F.col("second").cast("long").alias("second"), "samples"), ["video_id", "second"], "left")
    first = F.greatest(F.col("_a") - F.col("second") * rate, F.lit(0))
    length = F.least(F.col("_b") - F.col("second") * rate, F.lit(rate)) - first
    part = F.struct("second", F.slice("samples", (first + 1).cast("int"), length.cast("int")).alias("x"))
    found = rows.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.when(F.col("samples").isNotNull(), part))).alias("_p"))
    return found.select("video_id", "frame_idx", F.flatten(F.col("_p.x")).alias("chunk"))


_DECODERS: dict[str, Callable[[bytes], Iterator[dict]]] = {}


def register_decoder(kind: str, decode: Callable[[bytes], Iterator[dict]]) -> None:
    """``decode(file bytes)`` yields the rows of one file; it runs on executors, so its module has to be there."""
    _DECODERS[kind] = decode


def decoded(spark: SparkSession, path: str, kind: str, schema: str, glob: str = "*") -> DataFrame:
    """Files read as bytes by Spark and decoded by a registered plugin: path and the plugin's columns."""
    if kind not in _DECODERS:
        raise SourceError(f"no decoder {kind!r} is registered; known: {sorted(_DECODERS)}")
    decode = _DECODERS[kind]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, content in zip(frame["path"], frame["content"], strict=True):
                rows = [{"path": at, **row} for row in decode(content)]
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(run, f"path string, {schema}")
