"""Hashes of words and word shingles for whole Arrow columns of text.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, with A-Z taken as a-z.
Bytes of a batch are handled together with NumPy; nothing loops over words. A text of more than
two pieces is handled a piece at a time, so that temporary arrays don't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is a run of its own, cut at blanks inside.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 64, (16, 256), dtype=np.uint64)
_TABLE[:, ord("A") : ord("Z") + 1] = _TABLE[:, ord("a") : ord("z") + 1]
_TABLE = _TABLE.ravel()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that changes about half the bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: first, end, their bytes and offsets from 0."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def is_long(data: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether this is one text of more than two pieces."""
    return len(offsets) == 2 and len(data) > 2 * PIECE


def _next_blank(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that holds a blank, or the end."""
    while at < len(data):
        if (found := np.flatnonzero(_SPACE[data[at : at + PIECE]])).size:
            return at + int(found[0])
        at += PIECE
    return len(data)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the n + 1 bounds of each text's words among them."""
    if not is_long(data, offsets):
        return _word_hashes(data, offsets)
    at, parts = 0, []
    while at < len(data):
        end = _next_blank(data, at + PIECE)
        parts.append(_word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:n]
    starts = np.flatnonzero(starts)
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    ends = np.flatnonzero(ends)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.zeros(n, np.int64)
    at[starts] = starts
    np.maximum.accumulate(at, out=at)
    np.subtract(np.arange(n), at, out=at)
    x = _TABLE[((at & 15) << 8) | data]
    if (far := np.flatnonzero(at > 15)).size:
        turn = at[far] >> 4
        x[far] *= np.cumprod(np.full(int(turn.max()) + 1, _STEP))[turn]
    total = np.cumsum(x)
    h = total[ends]
    h[1:] -= total[starts[1:] - 1]
    if starts[0]:
        h[:1] -= total[starts[:1] - 1]
    h += (ends - starts + 1).astype(np.uint64) * _STEP
    return mix(h), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their bounds; repeats are kept.

    A text of 1 to k - 1 words has one shingle, the whole sequence; without words none.
    """
    count = np.diff(bounds)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(count)), made)
    start = np.arange(out_bounds[-1]) - out_bounds[:-1][text] + bounds[:-1][text]
    length = np.minimum(count, k)[text]
    h = mix(length.astype(np.uint64) + _STEP)
    for j in range(k):
        use = length > j
        part = words[np.where(use, start + j, 0)] if len(words) else np.zeros(0, np.uint64)
        h = np.where(use, mix(h * _STEP ^ part), h)
    return h, out_bounds
