"""Quality: nearest-neighbour voting over latent-semantic vectors.

Texts are hashed term counts of two kinds, words and the shapes of characters; a
term-document matrix of labelled texts (tf-idf) is cut to its leading singular vectors
(latent semantic analysis). The labelled vectors, at most ``MAX_LABELLED`` of ``RANK``
floats, go to every task; each document's cosine with all of them is computed exactly, a block
of documents at a time, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesift.llm.labelled import fitted
from cuesift.llm.toxicity import with_score
from cuesift.llm.words import PIECE, is_long, pieces, word_hashes

WORD_BITS, SHAPE_BITS, ORDERS = 12, 12, (1, 2, 3, 4)
RANK, NEIGHBOURS, SHARPNESS = 48, 25, 8
#: Most labelled rows and bytes of text that vectors are made of.
MAX_LABELLED, MAX_LABELLED_BYTES = 4_000, 24_000_000
_TERMS = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 2

#: Shapes: lower case 1, upper case 2, digit 3, space 4, line end 5, bytes of other letters 6, else the sign itself.
_SHAPE = np.arange(256, dtype=np.uint32) + 8
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[32], _SHAPE[10], _SHAPE[128:] = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Space:
    """idf by term, the projection, and the labelled rows' unit vectors and labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (texts, terms) of hashed words, of shape n-grams, and of immediate repeats."""
    n = len(offsets) - 1
    out = np.zeros((n, _TERMS), np.float32)
    words, bounds = word_hashes(data, offsets)
    of = np.repeat(np.arange(n), np.diff(bounds))
    flat = lambda text, term: np.bincount(text * _TERMS + term, minlength=n * _TERMS).reshape(n, _TERMS)
    if len(words):
        out += flat(of, (words >> np.uint64(64 - WORD_BITS)).astype(np.int64))
        again = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1]))
        out[:, -1] = np.bincount(of[again], minlength=n)
        out[:, -2] = np.diff(bounds)
    # one long text goes by in runs that overlap by what the longest n-gram reaches over
    step = PIECE if is_long(data, offsets) else max(len(data), 1)
    for a in range(0, len(data), step):
        run = data[a : a + step + max(ORDERS) - 1]
        text = np.zeros(len(run), np.int64) if n == 1 else np.repeat(np.arange(n), np.diff(offsets))
        shape = _SHAPE[run]
        h = np.zeros(len(shape), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            if len(shape) < order:
                break
            h = (h if order == 1 else h[:-1]) * np.uint32(0x01000193) + shape[order - 1 :]
            if order in ORDERS:
                k = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * order)) >> np.uint32(32 - SHAPE_BITS)
                use = np.flatnonzero(text[: len(k)] == text[order - 1 :])
                use = use[use < step]  # what starts later belongs to the next run
                out += flat(text[use], (1 << WORD_BITS) + k[use].astype(np.int64))
    return out


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf rows: words, shapes and the share of repeats each have a unit part."""
    share = counts[:, -1] / np.maximum(counts[:, -2], 1)
    out = np.log1p(counts) * idf
    for part in (slice(0, 1 << WORD_BITS), slice(1 << WORD_BITS, _TERMS - 2)):
        norm = np.sqrt((out[:, part] ** 2).sum(1, keepdims=True))
        out[:, part] /= np.maximum(norm, 1e-12)
    out[:, : 1 << WORD_BITS] *= 0.5
    out[:, -1] = np.minimum(1, 2 * share)
    out[:, -2] = 0
    return out.astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def fit(examples: list[tuple[str, int]], rank: int = RANK) -> Space:
    """The space of (text, 0 or 1) examples; its axes from the terms' covariance over random projections."""
    labels = np.array([y for _, y in examples], np.float64)
    column = pa.array([text for text, _ in examples], pa.large_string())
    blocks = [_terms(data, offsets) for _, _, data, offsets in pieces(column)]
    df = sum(((b > 0).sum(0) for b in blocks), np.zeros(_TERMS, np.int64))
    idf = np.log((1 + len(labels)) / (1 + df)).astype(np.float32) + 1
    for i, b in enumerate(blocks):  # one at a time: counts and weights together would be twice as much
        blocks[i] = _weighed(b, idf)
    if not blocks:
        return Space(idf, np.zeros((_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    rng = np.random.default_rng(7)
    q = rng.standard_normal((_TERMS, rank + 16)).astype(np.float32)
    for _ in range(6):  # subspace iteration on the uncentred covariance
        q, _ = np.linalg.qr(sum(b.T @ (b @ q) for b in blocks))
    small = sum((p := b @ q).T @ p for b in blocks)
    _, turn = np.linalg.eigh(small)
    axes = np.ascontiguousarray(q @ turn[:, ::-1][:, :rank], np.float32)
    return Space(idf, axes, _unit(np.vstack([b @ axes for b in blocks])), labels)


def vote(column: pa.Array, space: Space, neighbours: int = NEIGHBOURS, sharpness: int = SHARPNESS) -> np.ndarray:
    """For each text the share of label 1 among its nearest labelled texts, by cosine ** sharpness."""
    out = np.zeros(len(column))
    k = min(neighbours, len(space.labels))
    if not k:
        return np.full(len(column), 0.5)
    for start, end, data, offsets in pieces(column, 1 << 19):
        # a run of many short texts is cut so that its matrices stay small
        for a in range(0, end - start, 256):
            b = min(a + 256, end - start)
            part = offsets[a : b + 1]
            rows = _unit(_weighed(_terms(data[part[0] : part[-1]], part - part[0]), space.idf) @ space.axes)
            cosine = rows @ space.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 1e-3) ** sharpness
            out[start + a : start + b] = (weight * space.labels[near]).sum(1) / weight.sum(1)
    return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, max_bytes: int = MAX_LABELLED_BYTES) -> Space:
    """A space of ``labels.quality``, from a bounded sample outside fold 2 of 4."""
    return fitted(docs, labels, "quality", fit, max_rows, max_bytes)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """Score every document: ``docs`` with score in [0, 1] and predicted (score >= threshold).

    One pass without a shuffle; what goes to the tasks is bounded by
    ``MAX_LABELLED`` x ``RANK`` floats and the projection. Scores come from the text alone.
    Null text scores as empty, null ids are scored too, repeated rows
    score alike, very long texts are read whole, an empty table gives no rows; without labels
    every score is 0.5. Of equal cosines at the border of the neighbours, which vote isn't set by any
    order, but equal texts have equal votes. Input columns named score or predicted are replaced.
    """
    space = train(docs, labels, **bounds)
    scored = with_score(docs, lambda column: vote(column, space))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
