"""Runs of small non-negative integers as bytes (LEB128: 7 bits a byte, low bits first)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that ``unpack_parts`` unpacks at once.
PART = 1 << 18


def pack(values: np.ndarray) -> bytes:
    v = np.asarray(values).astype(np.uint64)
    if not len(v):
        return b""
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        more = v >= np.uint64(1) << np.uint64(bits)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max())):
        use = np.flatnonzero(size > i)
        byte = (v[use] >> np.uint64(7 * i)) & np.uint64(127)
        out[at[use] + i] = byte.astype(np.uint8) | np.where(size[use] > i + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)[: len(last)]
    size = last - first + 1
    out = np.zeros(len(last), np.int64)
    for i in range(int(size.max()) if len(size) else 0):
        use = np.flatnonzero(size > i)
        out[use] |= (raw[first[use] + i].astype(np.int64) & 127) << (7 * i)
    return out


def unpack_parts(data: bytes, part: int = PART) -> Iterator[np.ndarray]:
    """As ``unpack``, some ``part`` bytes at a time: what is held beside the bytes doesn't grow with them."""
    raw, at = np.frombuffer(data, np.uint8), 0
    while at < len(raw):
        end = min(at + part, len(raw))
        while raw[end - 1] >= 128:  # a value's last byte is below
            end += 1
        yield unpack(data[at:end])
        at = end
