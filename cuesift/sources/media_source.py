"""Media files as Spark data sources: ``y4m_frames`` and ``wav_seconds``, read by ranges with filters pushed into the scan.

    register_media_sources(spark)
    spark.read.format("y4m_frames").load(folder).where("frame between 300 and 310")
    spark.read.format("wav_seconds").option("rate", 16000).load(folder).where("path = '...' and second = 7")

The driver lists names and sizes only. Files are parted by size, small ones put together; a task works out from a file's
header which frames or seconds are its own, drops those that the filters exclude and reads the bytes of the rest.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cuesift.sources.media import BATCH_BYTES, PART_BYTES, RATE
from cuesift.sources.ranges import RangeFile, Wav, Y4m, file_system
from cuesift.sources.video import SourceError


class Share(InputPartition):
    """Some files' parts: (path, number of the part, number of parts)."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        super().__init__(None)
        self.pieces = pieces


def listed(path: str, glob: str) -> list[tuple[str, int]]:
    """Paths, as Spark writes them, and sizes of a file or of a folder's files, in order."""
    system, at = file_system(path)
    prefix = "file:" if isinstance(system, afs.LocalFileSystem) else path[: len(path) - len(path.partition("://")[2].partition("/")[2]) - 1]
    root = "" if prefix == "file:" else at[: len(at) - len(path.partition("://")[2].partition("/")[2]) - 1]
    found = system.get_file_info(at.rstrip("/"))
    if found.type == afs.FileType.NotFound:
        raise SourceError(f"no file or folder {path!r}")
    every = [found] if found.type == afs.FileType.File else system.get_file_info(afs.FileSelector(at.rstrip("/"), recursive=True))
    kept = [f for f in every if f.type == afs.FileType.File and fnmatch.fnmatchcase(f.base_name, glob) and not f.base_name.startswith((".", "_"))]
    return sorted((prefix + f.path[len(root) :], f.size) for f in kept)


class _Reader(DataSourceReader):
    """What both formats share; ``number`` is the column that counts rows of a file."""

    number = ""

    def __init__(self, options: dict):
        if "path" not in options:
            raise SourceError("no path was given")
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.part_bytes, self.strict = int(options.get("part_bytes", PART_BYTES)), str(options.get("strict", "true")).lower() == "true"
        self.paths: set[str] | None = None
        self.numbers: set[int] | None = None
        self.first, self.end = 0, None
        #: Bytes read by ``read`` where this object is.
        self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "path" and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = some if self.paths is None else self.paths & some
            elif name == self.number and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.numbers = some if self.numbers is None else self.numbers & some
            elif name == self.number and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif name == self.number and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.end = end if self.end is None else min(self.end, end)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        shares, now, size = [], [], 0
        for path, length in listed(self.path, self.glob):
            if self.paths is not None and path not in self.paths:
                continue
            parts = max(1, -(-length // self.part_bytes))
            for part in range(parts):
                if now and size + length / parts > self.part_bytes:
                    shares.append(Share(now))
                    now, size = [], 0
                now.append((path, part, parts))
                size += length / parts
        if now:
            shares.append(Share(now))
        return shares or [Share([])]

    def wanted(self, count: int, part: int, parts: int) -> Iterable[int]:
        """The numbers of a part of ``count`` that the filters let through, in order."""
        first, end = max(count * part // parts, self.first), count * (part + 1) // parts
        end = end if self.end is None else min(end, self.end)
        if self.numbers is None:
            return range(first, end)
        return sorted(x for x in self.numbers if x is not None and first <= x < end)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for path, part, parts in partition.pieces:
            file = RangeFile(path)
            try:
                yield from self.rows(file, part, parts)
            except Exception as e:
                if self.strict:
                    raise SourceError(f"{path}: {e}") from e
            finally:
                self.bytes_read += file.bytes_read
                file.close()

    def rows(self, file: RangeFile, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class FrameReader(_Reader):
    number = "frame"

    def rows(self, file: RangeFile, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        video = Y4m(file)
        wanted = self.wanted(video.frames, part, parts)
        step = max(1, BATCH_BYTES // max(1, video.head["width"] * video.head["height"]))
        for a in range(0, len(wanted), step):
            some = list(wanted[a : a + step])
            n = len(some)
            columns = [pa.array([file.path] * n), pa.array(some, pa.int64()), pa.array([video.head["width"]] * n, pa.int32()), pa.array([video.head["height"]] * n, pa.int32()), pa.array([video.luma(k) for k in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "frame", "width", "height", "luma"])


class SecondReader(_Reader):
    number = "second"

    def __init__(self, options: dict):
        super().__init__(options)
        self.rate = int(options.get("rate", RATE))

    def rows(self, file: RangeFile, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        sound = Wav(file, self.rate)
        wanted = self.wanted(-(-sound.samples // self.rate), part, parts)
        for a in range(0, len(wanted), 60):
            some = list(wanted[a : a + 60])
            parts_ = pa.array([sound.range(s * self.rate, (s + 1) * self.rate) for s in some], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([file.path] * len(some)), pa.array(some, pa.int32()), parts_], names=["path", "second", "samples"])


class FrameSource(DataSource):
    """``y4m_frames``: a row for each frame of YUV4MPEG2 files. Options: glob, part_bytes, strict (false leaves out files that can't be read)."""

    @classmethod
    def name(cls) -> str:
        return "y4m_frames"

    def schema(self) -> str:
        return "path string, frame bigint, width int, height int, luma binary"

    def reader(self, schema) -> DataSourceReader:
        return FrameReader({"glob": "*.y4m", **dict(self.options)})


class SecondSource(DataSource):
    """``wav_seconds``: a row for each second of PCM WAV files. Options: rate, glob, part_bytes, strict."""

    @classmethod
    def name(cls) -> str:
        return "wav_seconds"

    def schema(self) -> str:
        return "path string, second int, samples array<float>"

    def reader(self, schema) -> DataSourceReader:
        return SecondReader({"glob": "*.wav", **dict(self.options)})


def register_media_sources(spark: SparkSession) -> None:
    """Make ``y4m_frames`` and ``wav_seconds`` known to a session, with filters pushed into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    spark.dataSource.register(SecondSource)
