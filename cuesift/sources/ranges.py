"""Media files read by byte ranges: where frames and samples lie follows from a header, so nothing else is touched."""

from __future__ import annotations

import re
import wave
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyarrow import fs as afs

from cuesift.sources.video import SourceError

#: Bytes that a YUV4MPEG2 header, or the line before a frame, may have.
HEADER, LINE = 4096, 256
MARK = b"FRAME\n"


def file_system(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path as Spark writes it (a scheme is optional), and the path in it."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return afs.LocalFileSystem(), path
    if path.startswith("file:"):
        return afs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    scheme, _, rest = path.partition("://")
    authority, _, at = rest.partition("/")
    system, root = afs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{root.rstrip('/')}/{at}"


class RangeFile:
    """A file that is read at any place; ``bytes_read`` counts what was read."""

    def __init__(self, path: str):
        system, at = file_system(path)
        self._file = system.open_input_file(at)
        self.path, self.size, self.bytes_read, self._at = path, self._file.size(), 0, 0

    def read_at(self, at: int, n: int) -> bytes:
        found = self._file.read_at(n, at) if n > 0 and at < self.size else b""
        self.bytes_read += len(found)
        return found

    # the part of a file object that the wave module asks for

    def read(self, n: int = -1) -> bytes:
        found = self.read_at(self._at, self.size - self._at if n < 0 else n)
        self._at += len(found)
        return found

    def seek(self, at: int, whence: int = 0) -> int:
        self._at = at + (0, self._at, self.size)[whence]
        return self._at

    def tell(self) -> int:
        return self._at

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self._file.close()


def y4m_header(content: bytes) -> tuple[dict, int, int]:
    """(width, height and video_fps; where frames begin; bytes of a frame) of a YUV4MPEG2 file that begins with ``content``."""
    line, _, _ = content.partition(b"\n")
    words = line.decode("ascii", "replace").split(" ")
    if words[0] != "YUV4MPEG2":
        raise SourceError("not a YUV4MPEG2 file")
    tags = {w[0]: w[1:] for w in words[1:] if w}
    width, height = int(tags["W"]), int(tags["H"])
    colour = tags.get("C", "420jpeg")
    chroma = ((width + 1) // 2) * ((height + 1) // 2) if colour.startswith("420") else ((width + 1) // 2) * height if colour == "422" else width * height if colour == "444" else 0 if colour == "mono" else None
    if chroma is None:
        raise SourceError(f"colour space {colour!r} isn't known")
    return {"width": width, "height": height, "video_fps": float(Fraction(tags["F"].replace(":", "/")))}, len(line) + 1, width * height + 2 * chroma


class Y4m:
    """Frames of a YUV4MPEG2 file by number.

    Frames lie a fixed stride apart where their lines have no parameters; the first line, the last and what follows it
    say whether they do. Else the lines are walked through, pictures skipped. A frame cut short isn't one.
    """

    def __init__(self, file: RangeFile):
        self.file = file
        self.head, self._first, self._size = y4m_header(file.read_at(0, HEADER))
        self._stride, self._places = len(MARK) + self._size, None
        self.frames = max(0, file.size - self._first) // self._stride
        edge = [self._first + k * self._stride for k in {0, max(0, self.frames - 1), self.frames}]
        if not all(MARK.startswith(file.read_at(at, len(MARK))) for at in edge):
            self._places = np.fromiter(self._walk(), np.int64)
            self.frames = len(self._places)

    def _walk(self) -> Iterator[int]:
        at = self._first
        while at < self.file.size:
            line = self.file.read_at(at, LINE)
            end = line.find(b"\n")
            if not line.startswith(MARK[:-1]) or (end < 0 and at + LINE <= self.file.size):
                raise SourceError("no frame where one begins")
            at += end + 1 + self._size
            if end < 0 or at > self.file.size:
                return
            yield at - self._size

    def luma(self, k: int) -> bytes:
        """The picture of frame ``k``, row by row."""
        n = self.head["width"] * self.head["height"]
        if self._places is not None:
            return self.file.read_at(int(self._places[k]), n)
        found = self.file.read_at(self._first + k * self._stride, len(MARK) + n)
        if not found.startswith(MARK):
            raise SourceError(f"no frame {k} where it should begin")
        return found[len(MARK) :]


def pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """PCM bytes as doubles in [-1, 1], channels averaged."""
    raw = np.frombuffer(raw, np.uint8)
    raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        x = (raw[:, 0].astype(np.float64) - 128) / 128
    else:  # little-endian signed, the last byte carries the sign
        x = sum(raw[:, k].astype(np.int64) << 8 * k for k in range(width))
        x = np.where(x >= 1 << 8 * width - 1, x - (1 << 8 * width), x) / float(1 << 8 * width - 1)
    return x.reshape(-1, channels).mean(1)


class Wav:
    """Sound of a PCM WAV file by sample number at ``rate``; other rates are interpolated."""

    def __init__(self, file: RangeFile, rate: int):
        self._wave, self.file, self.rate = wave.open(file), file, rate
        self._width, self._channels, self._own = self._wave.getsampwidth(), self._wave.getnchannels(), self._wave.getframerate()
        there = max(0, file.size - file.tell()) // (self._width * self._channels)  # headers may claim more than there is
        self._n = min(self._wave.getnframes(), there)
        self.samples = self._n if self._own == rate else int(self._n * rate / self._own)

    def _frames(self, first: int, end: int) -> np.ndarray:
        self._wave.setpos(first)
        return pcm(self._wave.readframes(end - first), self._width, self._channels)

    def range(self, first: int, end: int) -> np.ndarray:
        """Samples ``first`` to ``end`` (not included), equal to the same part of the whole sound."""
        end = min(end, self.samples)
        if first >= end:
            return np.zeros(0, np.float32)
        if self._own == self.rate:
            return self._frames(first, end).astype(np.float32)
        place = np.arange(first, end) * (self._own / self.rate)
        a, b = min(int(place[0]), self._n - 1), min(int(place[-1]) + 2, self._n)
        return np.interp(place, np.arange(a, b), self._frames(a, b)).astype(np.float32)
