"""Decoders that need no codec: WAV sound and YUV4MPEG2 video, and the tables read with them.

Frames and seconds of these formats are read where they lie (``ranges``). Other formats are plugins (``register_decoder``), their
files read whole. A file that can't be decoded gives a row with ``error`` or fails, as ``strict`` says.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesift.sources.ranges import MARK, RangeFile, Wav, Y4m, file_system, pcm, y4m_header
from cuesift.sources.video import SourceError

RATE = 16_000
#: Bytes of a file to a task, source frames of a file to a task, bytes of pictures in a batch.
PART_BYTES, SPAN, BATCH_BYTES = 32 << 20, 1024, 16 << 20


def wav_samples(content: bytes, rate: int = RATE) -> np.ndarray:
    """A PCM WAV file's sound as mono floats in [-1, 1] at ``rate``; channels are averaged, other rates interpolated."""
    with wave.open(io.BytesIO(content)) as file:
        channels, width, own, n = file.getnchannels(), file.getsampwidth(), file.getframerate(), file.getnframes()
        x = pcm(file.readframes(n), width, channels)
    if own != rate and len(x):
        x = np.interp(np.arange(int(len(x) * rate / own)) * (own / rate), np.arange(len(x)), x)
    return x.astype(np.float32)


def y4m_frames(content: bytes) -> Iterator[np.ndarray]:
    """The luma planes (height, width) of a YUV4MPEG2 file, in order; a frame cut short ends it."""
    head, at, size = y4m_header(content)
    while at < len(content):
        end = content.index(b"\n", at) + 1
        if not content.startswith(b"FRAME", at):
            raise SourceError("no frame where one begins")
        if end + size > len(content):
            return
        yield np.frombuffer(content, np.uint8, head["width"] * head["height"], end).reshape(head["height"], head["width"])
        at = end + size


#: Probes and sounds of files read as bytes; endings that plugins don't claim and ``ranges`` knows are read by ranges.
_PROBES: dict[str, Callable[[bytes], dict]] = {}
_SOUNDS: dict[str, Callable[[bytes, int], np.ndarray]] = {".wav": wav_samples}


def register_probe(ending: str, probe: Callable[[bytes], dict]) -> None:
    """``probe(bytes)`` gives width, height, video_fps and total_frames of files with that ending."""
    _PROBES[ending.lower()] = probe


def register_sound(ending: str, samples: Callable[[bytes, int], np.ndarray]) -> None:
    """``samples(bytes, rate)`` gives mono floats of files with that ending."""
    _SOUNDS[ending.lower()] = samples


def _plugin(plugins: dict, path: str, *built_in: str):
    for ending, found in plugins.items():
        if path.lower().endswith(ending):
            return found
    raise SourceError(f"no decoder for {path!r}; known endings: {sorted({*plugins, *built_in})}")


def _each(spark: SparkSession, path: str, glob: str, schema: str, make: Callable[[str, bytes], dict], strict: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    names = ["path", *[part.split()[0] for part in schema.split(", ")], "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    row = {**make(at, content), "error": None}
                except Exception as e:
                    if strict:
                        raise SourceError(f"{at}: {e}") from e
                    row = {"error": str(e)}
                row["path"] = at
                yield pd.DataFrame({name: pd.Series([row.get(name)], dtype=object) for name in names})

    return files.mapInPandas(run, f"path string, {schema}, error string")


def _names(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length) of files; what is in them isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")


def _tasks(spark: SparkSession) -> int:
    """Tasks for rows that are small but stand for much reading; a number of its own, as adaptive plans would put them all into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _ends(path: str, ending: str) -> bool:
    return path.lower().endswith(ending)


def _whole(path: str) -> bytes:
    file = RangeFile(path)
    try:
        return file.read_at(0, file.size)
    finally:
        file.close()


def video_table(spark: SparkSession, path: str, glob: str = "*", strict: bool = True) -> DataFrame:
    """(path, width, height, video_fps, total_frames, duration, error) of video files; a rate of 0 or less has duration 0.

    Of a YUV4MPEG2 file only the header and three frames' first bytes are read; plugins' files are read whole.
    """
    plugins = dict(_PROBES)
    columns = ["path", "width", "height", "video_fps", "total_frames", "duration", "error"]

    def probe(at: str) -> dict:
        if any(_ends(at, e) for e in plugins) or not _ends(at, ".y4m"):
            return _plugin(plugins, at, ".y4m")(_whole(at))
        file = RangeFile(at)
        try:
            video = Y4m(file)
            return {**video.head, "total_frames": video.frames}
        finally:
            file.close()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at in batch["path"]:
                try:
                    found = probe(at)
                    rows.append({**found, "path": at, "duration": found["total_frames"] / found["video_fps"] if found["video_fps"] > 0 else 0.0, "error": None})
                except Exception as e:
                    if strict:
                        raise SourceError(f"{at}: {e}") from e
                    rows.append({"path": at, "error": str(e)})
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})

    return _names(spark, path, glob).mapInPandas(run, "path string, width int, height int, video_fps double, total_frames bigint, duration double, error string")


def full_audio(spark: SparkSession, path: str, glob: str = "*", rate: int = RATE, strict: bool = False) -> DataFrame:
    """(path, samples, duration, error): the whole sound of each file, null samples where there is none to be had."""
    plugins = dict(_SOUNDS)

    def make(at: str, content: bytes) -> dict:
        x = _plugin(plugins, at)(content, rate)
        if not len(x):
            raise SourceError("no sound")
        return {"samples": x.tolist(), "duration": len(x) / rate}

    return _each(spark, path, glob, "samples array<float>, duration double", make, strict)


def _seekable(plugins: dict, path: str) -> bool:
    """A WAV file that no plugin has been registered for."""
    return _ends(path, ".wav") and _plugin(plugins, path) is wav_samples


def audio_seconds(spark: SparkSession, path: str, glob: str = "*", rate: int = RATE, strict: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, second, samples, error): the sound of each file, a row for each second; a file that can't be read has one row with null samples.

    A WAV file is read by ranges of whole seconds, about ``part_bytes`` to a task, so that one long file is many tasks' work;
    files of plugins are read whole. Equal to the seconds of the whole sound.
    """
    plugins = dict(_SOUNDS)
    parts = F.when(F.lower("path").endswith(".wav") if plugins.get(".wav") is wav_samples else F.lit(False), F.greatest(F.lit(1), F.ceil(F.col("length") / part_bytes).cast("int"))).otherwise(F.lit(1))
    files = _names(spark, path, glob).select("path", parts.alias("parts")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).repartition(_tasks(spark), "path", "part")
    schema = "path string, second int, samples array<float>, error string"

    def rows(at: str, numbers: list, parts: list, error: str | None) -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays([pa.array([at] * n), pa.array(numbers, pa.int32()), pa.array(parts, pa.list_(pa.float32())), pa.array([error] * n, pa.string())], names=["path", "second", "samples", "error"])

    def minutes(at: str, part: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first second, samples) of at most a minute each."""
        if _seekable(plugins, at):
            file = RangeFile(at)
            try:
                sound = Wav(file, rate)
                seconds = -(-sound.samples // rate)
                if not seconds:
                    raise SourceError("no sound")
                first, end = seconds * part // parts, seconds * (part + 1) // parts
                for a in range(first, end, 60):
                    yield a, sound.range(a * rate, min(a + 60, end) * rate)
            finally:
                file.close()
            return
        x = _plugin(plugins, at)(_whole(at), rate)
        if not len(x):
            raise SourceError("no sound")
        for a in range(0, len(x), 60 * rate):
            yield a // rate, x[a : a + 60 * rate]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked in batch.select(["path", "part", "parts"]).to_pylist():
                at = asked["path"]
                try:
                    for first, minute in minutes(at, asked["part"], asked["parts"]):
                        found = [minute[k : k + rate] for k in range(0, len(minute), rate)]
                        yield rows(at, list(range(first, first + len(found))), found, None)
                except Exception as e:
                    if strict:
                        raise SourceError(f"{at}: {e}") from e
                    if asked["part"] == 0:
                        yield rows(at, [None], [None], str(e))

    return files.mapInArrow(run, schema)


def audio_duration(spark: SparkSession, path: str, glob: str = "*", rate: int = RATE) -> DataFrame:
    """(path, duration), null where a file can't be read or has no sound; of WAV files only the header is read."""
    plugins = dict(_SOUNDS)

    def duration(at: str) -> float | None:
        try:
            if not _seekable(plugins, at):
                n = len(_plugin(plugins, at)(_whole(at), rate))
            else:
                file = RangeFile(at)
                try:
                    n = Wav(file, rate).samples
                finally:
                    file.close()
            return n / rate if n else None
        except Exception:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([duration(x) for x in batch["path"].to_pylist()], pa.float64())], names=["path", "duration"])

    return _names(spark, path, glob).mapInArrow(run, "path string, duration double")


def luma_frames(spark: SparkSession, path: str, grid: DataFrame, glob: str = "*.y4m", bytes_read: Accumulator | None = None) -> DataFrame:
    """Pictures of a grid's frames (path, frame_idx, source_frame): path, frame_idx, height, width, luma (bytes, row by row).

    Only names and numbers are shuffled: a task has some spans of files and reads the frames asked for where they lie. Frames past
    a file's end, and files that aren't there, are left out. ``bytes_read`` counts what was read of the files.
    """
    asked = grid.select("path", "frame_idx", "source_frame").join(_names(spark, path, glob).select("path"), "path", "left_semi")
    asked = asked.repartition(_tasks(spark), "path", F.expr(f"source_frame div {SPAN}")).sortWithinPartitions("path", "source_frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, video, rows, size = None, None, [], 0

        def packed() -> pa.RecordBatch:
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "frame_idx", "height", "width", "luma"])

        def done() -> None:
            if video is not None:
                if bytes_read is not None:
                    bytes_read.add(video.file.bytes_read)
                video.file.close()

        for batch in batches:
            for at, frame_idx, k in zip(*(batch[c].to_pylist() for c in ("path", "frame_idx", "source_frame")), strict=True):
                if at != here:
                    done()
                    here, video = at, Y4m(RangeFile(at))
                if k is not None and 0 <= k < video.frames:
                    rows.append((at, frame_idx, video.head["height"], video.head["width"], video.luma(k)))
                    size += len(rows[-1][-1])
                if size >= BATCH_BYTES:
                    yield packed()
                    rows, size = [], 0
        done()
        if rows:
            yield packed()

    return asked.mapInArrow(run, "path string, frame_idx int, height int, width int, luma binary")


def write_y4m(frames: DataFrame, fps: float, columns: Sequence[str] = ("path", "frame", "width", "height", "luma")) -> int:
    """Write pictures (path, frame, width, height, luma) as files of grey YUV4MPEG2, one for each path, frames in order; how many files.

    A file is written beside its place and moved there, so that an attempt that was lost leaves nothing half done.
    """
    rows = frames.select(*(F.col(c).alias(n) for c, n in zip(columns, ("path", "frame", "width", "height", "luma"), strict=True)))
    rate = Fraction(fps).limit_denominator(1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, here, out, size, n = uuid.uuid4().hex, None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                system, at = file_system(here)
                system.move(f"{at}.{tag}", at)

        for batch in batches:
            for path, width, height, luma in zip(*(batch[c].to_pylist() for c in ("path", "width", "height", "luma")), strict=True):
                if path != here:
                    close()
                    system, at = file_system(path)
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    here, size, n = path, (width, height), n + 1
                    out = system.open_output_stream(f"{at}.{tag}")
                    out.write(f"YUV4MPEG2 W{width} H{height} F{rate.numerator}:{rate.denominator} Ip Cmono\n".encode())
                if (width, height) != size or len(luma) != width * height:
                    raise SourceError(f"{path}: pictures of unlike sizes")
                out.write(MARK + luma)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    made = rows.repartition(_tasks(frames.sparkSession), "path").sortWithinPartitions("path", "frame").mapInArrow(run, "files bigint")
    return made.agg(F.sum("files")).first()[0] or 0
