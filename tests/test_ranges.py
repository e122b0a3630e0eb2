"""Media read by ranges: equal to whole files, and no byte more than needed."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, LessThan

from cuesift.sources import media
from cuesift.sources.media_source import FrameReader, SecondReader, register_media_sources
from cuesift.sources.ranges import RangeFile, Wav, Y4m
from cuesift.sources.video import SourceError
from test_media import wav, y4m

W, H = 16, 12


def pictures(n, seed=1):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 256, (H, W), dtype=np.uint8) for _ in range(n)]


def test_frames_lie_where_the_header_says(tmp_path):
    frames = pictures(50)
    for colour in ("420jpeg", "mono"):
        (tmp_path / "a.y4m").write_bytes(y4m(frames, colour))
        video = Y4m(RangeFile(str(tmp_path / "a.y4m")))
        assert video.frames == 50 and video.file.bytes_read < 5_000
        before = video.file.bytes_read
        assert video.luma(37) == frames[37].tobytes() and video.file.bytes_read - before == W * H + 6
    (tmp_path / "empty.y4m").write_bytes(y4m(frames, "mono")[:50])
    assert Y4m(RangeFile(f"file:{tmp_path}/empty.y4m")).frames == 0


def test_frame_lines_with_parameters_are_walked(tmp_path):
    frames = pictures(9)
    head = y4m(frames, "mono").partition(b"\n")[0] + b"\n"
    body = b"".join((b"FRAME Xn=%d\n" % i if i % 2 else b"FRAME\n") + f.tobytes() for i, f in enumerate(frames))
    (tmp_path / "p.y4m").write_bytes(head + body)
    video = Y4m(RangeFile(str(tmp_path / "p.y4m")))
    assert video.frames == 9 and [video.luma(k) for k in range(9)] == [f.tobytes() for f in frames]
    (tmp_path / "cut.y4m").write_bytes((head + body)[:-1])
    assert Y4m(RangeFile(str(tmp_path / "cut.y4m"))).frames == 8
    (tmp_path / "bad.y4m").write_bytes(head + body + b"rubbish")
    with pytest.raises(SourceError, match="no frame"):
        Y4m(RangeFile(str(tmp_path / "bad.y4m")))


@pytest.mark.parametrize("own, channels, width", [(16_000, 1, 2), (16_000, 2, 1), (8_000, 1, 2), (44_100, 2, 3), (11_025, 1, 4)])
def test_ranges_of_sound_are_the_whole_sounds(tmp_path, own, channels, width):
    content = wav(np.random.default_rng(own).uniform(-1, 1, own * channels * 2 + 77 * channels).tolist(), own, channels, width)
    (tmp_path / "s.wav").write_bytes(content)
    whole, sound = media.wav_samples(content), Wav(RangeFile(str(tmp_path / "s.wav")), 16_000)
    assert sound.samples == len(whole)
    for a, b in ((0, 100), (15_990, 16_010), (len(whole) - 5, len(whole) + 50), (0, len(whole)), (9, 9)):
        assert sound.range(a, b).tolist() == whole[a:b].tolist()
    cut = Wav(RangeFile(str(tmp_path / "s.wav")), 16_000)
    cut.range(16_000, 16_100)
    assert cut.file.bytes_read < 200 + 3 * 100 * width * channels * max(1, own / 16_000)


def test_headers_that_claim_too_much(tmp_path):
    content = wav([0.5] * 1_000, 16_000)
    (tmp_path / "s.wav").write_bytes(content[:-500])
    sound = Wav(RangeFile(str(tmp_path / "s.wav")), 16_000)
    assert sound.samples == 750 and len(sound.range(0, 10_000)) == 750


def test_point_reads_touch_their_bytes_only(spark, tmp_path):
    frames = pictures(3_000)
    for name in ("a b", "c"):
        (tmp_path / f"{name}.y4m").write_bytes(y4m(frames, "mono"))
    at = f"file://{tmp_path}"
    paths = {r.path[-5:]: r.path for r in media.video_table(spark, at).collect()}
    asked = [(paths["b.y4m"], i, k) for i, k in enumerate((2_999, 5, 5, 1_700, 4_000))] + [("file:/nowhere.y4m", 0, 0)]
    asked = spark.createDataFrame(asked, "path string, frame_idx int, source_frame long")
    count = spark.sparkContext.accumulator(0)
    got = media.luma_frames(spark, at, asked, bytes_read=count).collect()
    assert {r.frame_idx: bytes(r.luma) for r in got} == {i: frames[k].tobytes() for i, k in enumerate((2_999, 5, 5, 1_700))}
    assert count.value < 4 * (W * H + 6) + 3 * 4_200  # a header for each span


def test_long_sound_is_many_tasks(spark, tmp_path):
    content = wav(np.random.default_rng(3).uniform(-1, 1, 150_000).tolist(), 8_000)
    (tmp_path / "long.wav").write_bytes(content)
    whole = media.wav_samples(content)
    rows = media.audio_seconds(spark, f"file://{tmp_path}", "*.wav", part_bytes=40_000).withColumn("task", F.spark_partition_id()).collect()
    rows.sort(key=lambda r: r.second)
    assert [r.second for r in rows] == list(range(19)) and sum((r.samples for r in rows), []) == whole.tolist()
    assert len({r.task for r in rows}) > 1


def test_sources_push_filters(spark, tmp_path):
    register_media_sources(spark)
    frames = pictures(300)
    (tmp_path / "v").mkdir()
    for name in ("a", "b"):
        (tmp_path / "v" / f"{name}.y4m").write_bytes(y4m(frames, "mono"))
    (tmp_path / "v" / "s.wav").write_bytes(wav([i % 100 / 100 for i in range(40_000)], 16_000))
    at = f"file://{tmp_path}/v"
    table = spark.read.format("y4m_frames").option("part_bytes", 10_000).load(at)
    assert table.rdd.getNumPartitions() > 2 and table.count() == 600
    got = table.where(f"path = 'file:{tmp_path}/v/b.y4m' and frame >= 120 and frame < 124 and length(luma) > 0").collect()
    assert sorted((r.frame, bytes(r.luma)) for r in got) == [(k, frames[k].tobytes()) for k in range(120, 124)]
    assert {(r.path[-5:], r.frame) for r in table.where("frame in (7, 299, 300)").collect()} == {(p, k) for p in ("a.y4m", "b.y4m") for k in (7, 299)}
    assert table.where("frame = 1 and frame = 2").count() == 0 and table.where("frame is null").count() == 0
    seconds = spark.read.format("wav_seconds").load(at).where("second > 0").orderBy("second").collect()
    assert [(r.second, len(r.samples)) for r in seconds] == [(1, 16_000), (2, 8_000)]
    reader = FrameReader({"path": at, "glob": "*.y4m"})
    odd = EqualTo(("width",), 3)
    assert list(reader.pushFilters([EqualTo(("path",), f"file:{tmp_path}/v/a.y4m"), In(("frame",), (3, 250)), LessThan(("frame",), 200), odd])) == [odd]
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b["frame"].to_pylist() for b in rows] == [[3]] and reader.bytes_read < 4_200 + W * H


def test_sources_with_bad_and_no_files(spark, tmp_path):
    register_media_sources(spark)
    (tmp_path / "bad.y4m").write_bytes(b"nothing of the kind")
    (tmp_path / "ok.y4m").write_bytes(y4m(pictures(2), "mono"))
    at = f"file://{tmp_path}"
    with pytest.raises(Exception, match="bad.y4m"):
        spark.read.format("y4m_frames").load(at).collect()
    assert spark.read.format("y4m_frames").option("strict", "false").load(at).count() == 2
    assert spark.read.format("y4m_frames").option("glob", "none*").load(at).count() == 0
    with pytest.raises(Exception, match="no file"):
        SecondReader({"path": f"{at}/missing"}).partitions()


def test_written_videos_are_read_back(spark, tmp_path):
    frames = pictures(40)
    rows = [(f"file:{tmp_path}/out/{v}.y4m", k, W, H, frames[(k + v) % 40].tobytes()) for v in range(3) for k in range(20)]
    table = spark.createDataFrame(rows, "path string, frame int, width int, height int, luma binary").repartition(5)
    assert media.write_y4m(table, 30000 / 1001) == 3
    register_media_sources(spark)
    back = spark.read.format("y4m_frames").load(f"file://{tmp_path}/out").collect()
    assert sorted((r.path, r.frame, bytes(r.luma)) for r in back) == sorted((p, k, x) for p, k, _, _, x in rows)
    assert media.video_table(spark, f"file://{tmp_path}/out").first().video_fps == pytest.approx(30000 / 1001)
    assert media.write_y4m(table.where("false"), 1.0) == 0
    with pytest.raises(Exception, match="unlike sizes"):
        media.write_y4m(table.withColumn("luma", F.expr("substring(luma, 1, 5)")), 1.0)
