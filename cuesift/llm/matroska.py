"""Matroska media columns: EBML elements, clusters, lacing and cues into packet tables.

``packets`` reads a file's bytes into rows of (track, time, byte range); the muxer writes 8-bit
PCM, with all four kinds of lacing, so that a stored payload can be read back exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from cuesift.llm.storage import written

# Fixed values of the format: element ids as written in a file, length marker included.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
DOC_TYPE, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x4282, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACING = ("none", "xiph", "fixed", "ebml")

FRAME = 64  # bytes of payload in a frame
RATE = 8000  # samples a second; a frame is 8 ms
FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER = 8, 16
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS, EBML}


class Packet(NamedTuple):
    """One frame: where its bytes are in the file and when it is shown."""

    track: int
    time_ns: int
    start: int
    size: int
    keyframe: bool
    cluster: int
    lacing: str


class Media(NamedTuple):
    """What a file holds: packets, tracks by number, cues (time, track, cluster's offset), duration."""

    packets: list[Packet]
    tracks: dict[int, dict]
    cues: list[tuple[int, int, int]]
    duration: float
    clusters: list[int]


def _vint(data: bytes, at: int, marker: bool) -> tuple[int, int, bool]:
    """A variable-length integer: value (with its marker bit for ids), end, whether all bits are ones."""
    first = data[at]
    if not first:
        raise ValueError(f"a length of more than 8 bytes at {at}")
    length = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + length], "big")
    if at + length > len(data):
        raise ValueError(f"the file ends within an integer at {at}")
    ones = (1 << (7 * length)) - 1
    return raw if marker else raw & ones, at + length, raw & ones == ones


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between two offsets; an unknown size ends at its parent's end."""
    while at < end:
        kind, at, _ = _vint(data, at, True)
        size, at, unknown = _vint(data, at, False)
        stop = end if unknown else at + size
        if stop > end:
            raise ValueError(f"element {kind:X} at {at} leaves its parent")
        if unknown and kind == CLUSTER:  # it lasts until an element that can't be its child
            stop = at
            while stop < end:
                child, past, _ = _vint(data, stop, True)
                if child in _TOP:
                    break
                length, past, _ = _vint(data, past, False)
                stop = past + length
        yield kind, at, stop
        at = stop


def _uint(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def _float(data: bytes, start: int, end: int) -> float:
    return float(np.frombuffer(data[start:end], ">f4" if end - start == 4 else ">f8")[0]) if end > start else 0.0


def _frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if lacing == 0:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide the block")
        return [(end - at) // count] * count, at
    sizes = []
    for i in range(count - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        else:
            start = at
            value, at, _ = _vint(data, at, False)
            bias = (1 << (7 * (at - start) - 1)) - 1
            sizes.append(value if i == 0 else sizes[-1] + value - bias)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing leaves its block")
    return sizes, at


def parse(data: bytes) -> Media:
    """Read a whole file. Raises ValueError where the bytes aren't Matroska."""
    packets, tracks, cues, clusters, duration, scale = [], {}, [], [], 0.0, 1_000_000
    try:
        for kind, start, end in elements(data, 0, len(data)):
            if kind != SEGMENT:
                continue
            for part, a, b in elements(data, start, end):
                if part == INFO:
                    for x, c, d in elements(data, a, b):
                        scale = _uint(data, c, d) if x == TIMESTAMP_SCALE else scale
                        duration = _float(data, c, d) if x == DURATION else duration
                elif part == TRACKS:
                    for _, c, d in elements(data, a, b):
                        fields = {x: (e, f) for x, e, f in elements(data, c, d)}
                        one = {"codec": data[slice(*fields[CODEC_ID])].decode(), "type": _uint(data, *fields[TRACK_TYPE]), "frame_ns": _uint(data, *fields.get(DEFAULT_DURATION, (0, 0)))}
                        for x, e, f in elements(data, *fields[AUDIO]) if AUDIO in fields else ():
                            one |= {"rate": _float(data, e, f)} if x == SAMPLING_FREQUENCY else {"channels": _uint(data, e, f)} if x == CHANNELS else {"bits": _uint(data, e, f)} if x == BIT_DEPTH else {}
                        tracks[_uint(data, *fields[TRACK_NUMBER])] = one
                elif part == CUES:
                    for _, c, d in elements(data, a, b):
                        time = 0
                        for x, e, f in elements(data, c, d):
                            if x == CUE_TIME:
                                time = _uint(data, e, f)
                            elif x == CUE_TRACK_POSITIONS:
                                at = {y: _uint(data, g, h) for y, g, h in elements(data, e, f)}
                                cues.append((time * scale, at[CUE_TRACK], start + at[CUE_CLUSTER_POSITION]))
                elif part == CLUSTER:
                    base, number = 0, len(clusters)
                    clusters.append(a)
                    for x, c, d in elements(data, a, b):
                        if x == CLUSTER_TIMESTAMP:
                            base = _uint(data, c, d)
                        elif x == SIMPLE_BLOCK:
                            _block(data, c, d, base, scale, tracks, number, None, packets)
                        elif x == BLOCK_GROUP:
                            inner = {y: (g, h) for y, g, h in elements(data, c, d)}
                            _block(data, *inner[BLOCK], base, scale, tracks, number, REFERENCE_BLOCK not in inner, packets)
    except (IndexError, KeyError) as e:
        raise ValueError("not a whole Matroska file") from e
    if not clusters and not tracks:
        raise ValueError("no Matroska segment")
    return Media(packets, tracks, cues, duration * scale / 1e9, clusters)


def _block(data: bytes, at: int, end: int, base: int, scale: int, tracks: dict, cluster: int, key: bool | None, out: list[Packet]) -> None:
    track, at, _ = _vint(data, at, False)
    time = base + int.from_bytes(data[at : at + 2], "big", signed=True)
    flags, at = data[at + 2], at + 3
    lacing = flags >> 1 & 3
    sizes, at = _frame_sizes(data, at, end, lacing)
    step = tracks.get(track, {}).get("frame_ns", 0)
    for i, size in enumerate(sizes):
        out.append(Packet(track, time * scale + i * step, at, size, bool(flags & 0x80) if key is None else key, cluster, LACING[lacing]))
        at += size


def _size(n: int) -> bytes:
    length = max(1, (n.bit_length() + 6) // 7)
    length += n == (1 << (7 * length)) - 1  # all ones means unknown
    return (n | 1 << (7 * length)).to_bytes(length, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 3 and len(frames) > 1:
        head += _size(len(frames[0]))
        for before, f in zip(frames, frames[1:-1], strict=False):
            diff, length = len(f) - len(before), 1
            while abs(diff) > (1 << (7 * length - 1)) - 1:
                length += 1
            head += (diff + (1 << (7 * length - 1)) - 1 | 1 << (7 * length)).to_bytes(length, "big")
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file of ``payload`` (whole frames of 64 bytes) as 8-bit mono samples at 8 kHz.

    Blocks of 8 frames use Xiph, fixed and EBML lacing in turn; the last frame is a block
    without lacing. The same payload gives the same bytes.
    """
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload has to be whole frames")
    ms = FRAME * 1000 // RATE
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    groups = [frames[i : i + FRAMES_IN_BLOCK] for i in range(0, len(frames) - 1, FRAMES_IN_BLOCK)]
    if groups and sum(map(len, groups)) == len(frames):
        groups[-1] = groups[-1][:-1]
    groups = [g for g in groups if g] + [frames[-1:]]
    head = _element(EBML, _number(EBML_VERSION, 1) + _number(EBML_READ_VERSION, 1) + _number(MAX_ID_LENGTH, 4) + _number(MAX_SIZE_LENGTH, 8) + _element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2))
    length = np.array([len(frames) * ms], ">f8").tobytes()
    body = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, length) + _element(MUXING_APP, b"cuesift") + _element(WRITING_APP, b"cuesift"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, np.array([RATE], ">f8").tobytes()) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    track = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(DEFAULT_DURATION, ms * 1_000_000) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts, cues, time = [body, _element(TRACKS, _element(TRACK_ENTRY, track))], [], 0
    at = sum(map(len, parts))
    for i in range(0, len(groups), BLOCKS_IN_CLUSTER):
        base, blocks = time, []
        for k, group in enumerate(groups[i : i + BLOCKS_IN_CLUSTER], i):
            lacing = 0 if len(group) == 1 else 1 + k % 3
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + (time - base).to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + _laced(group, lacing)))
            time += ms * len(group)
        cluster = _element(CLUSTER, _number(CLUSTER_TIMESTAMP, base) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, base) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


def demux(data: bytes, track: int | None = None) -> bytes:
    """The frames of a track (the first by default), in order."""
    media = parse(data)
    track = min(media.tracks, default=None) if track is None else track
    return b"".join(data[p.start : p.start + p.size] for p in media.packets if p.track == track)


def feature(data: bytes, media: Media) -> str:
    """A summary of the packet table: counts, duration, cues that point at a cluster, times, loudness."""
    starts = set(media.clusters)
    good = sum(_is_cluster(data, at, starts) for _, _, at in media.cues)
    samples = np.frombuffer(b"".join(data[p.start : p.start + p.size] for p in media.packets), np.uint8)
    level = np.abs(samples.astype(np.int64) - 128)
    crossings = int(((samples[1:] >= 128) != (samples[:-1] >= 128)).sum())
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={good};ms={int(round(media.duration * 1000))};last_ms={max((p.time_ns for p in media.packets), default=0) // 1_000_000};level={int(level.sum())};crossings={crossings}"


def _is_cluster(data: bytes, at: int, starts: set[int]) -> bool:
    """Whether the element at ``at`` is a cluster whose body starts at one of ``starts``: what a cue has to point at."""
    try:
        kind, end, _ = _vint(data, at, True)
        return kind == CLUSTER and _vint(data, end, False)[1] in starts
    except (IndexError, ValueError):
        return False


def padded(text: bytes) -> bytes:
    """``text`` with bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % FRAME if text else FRAME)


_PACKETS = "id {id}, packet int, track int, time_ns bigint, start bigint, size bigint, keyframe boolean, cluster int, lacing string, error string"


def packet_table(media: DataFrame) -> DataFrame:
    """(id, content) -> one row per packet: id, packet, track, time_ns, start, size, keyframe, cluster, lacing.

    ``content`` is a file's bytes; start and size are its byte range. Bytes that aren't a whole
    Matroska file, empty ones and null give one row with ``error`` and nulls. Rows are
    independent, so nothing is shuffled; an empty table gives no rows, repeated
    rows repeat theirs, other columns aren't read.
    """
    kind = media.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(kind), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        names = ["id", "packet", "track", "time_ns", "start", "size", "keyframe", "cluster", "lacing", "error"]
        for batch in batches:
            for i, content in zip(batch["id"].to_pylist(), batch["content"], strict=True):
                try:
                    rows = [(i, n, p.track, p.time_ns, p.start, p.size, p.keyframe, p.cluster, p.lacing, None) for n, p in enumerate(parse(content.as_py() or b"").packets)]
                except ValueError as e:
                    rows = [(i, *[None] * 8, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select("id", "content").mapInArrow(run, _PACKETS.format(id=kind.simpleString()))


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, content): each text as a Matroska file. Null is empty; cases as in ``stored_texts``."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(text.as_py() or "").encode() for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes bigint, content binary")


def digests(media: DataFrame) -> DataFrame:
    """Stored files (doc_id, n_bytes, content) -> what ``stored_texts`` returns, by the packets read from them."""
    kind = media.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                data = content.as_py()
                media = parse(data)
                back = b"".join(data[p.start : p.start + p.size] for p in media.packets)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, media)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", *names])

    return media.mapInArrow(run, schema)


def stored_texts(docs: DataFrame) -> DataFrame:
    """Store each text as a Matroska file in a table, read the table back, and return a digest of both per row.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. The payload is the UTF-8 text with bytes 0 up to a positive multiple of 64; its hash, the
    checksum of its last 64 bytes and the feature come from the packets of the stored
    files. Null is empty (64 zero bytes), equal texts have equal values, very long texts are
    stored whole, repeated rows and null ids come back row by row, an empty table gives no rows.
    """
    return digests(written(media_table(docs), "media"))
