"""Scores of frames against many query vectors: a matrix product for each Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Bytes of query vectors that go to every task; more of them go in several passes.
MOST_BYTES = 64 << 20
#: Scores of an output batch.
AT_ONCE = 1 << 17


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists that have ``dim`` values, none of them null, and these values in double precision."""
    column = column.cast(pa.list_(pa.float64()))
    length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # without the values of null lists
    sizes = np.maximum(length, 0)
    start = np.cumsum(sizes) - sizes
    at = np.flatnonzero(length == dim)
    place = start[at, None] + np.arange(dim)
    good = ~np.asarray(flat.is_null())[place].any(1)
    return at[good], flat.fill_null(0.0).to_numpy(zero_copy_only=False)[place[good]]


def _products(column: pa.Array, vectors: list[np.ndarray], cosine: bool, tiny: float = 1e-9, other: float = -1.0) -> np.ndarray:
    """Products of each list with each vector; those of unlike lengths or with nulls count as ``other``. A cosine with a vector shorter than ``tiny`` is 0."""
    out = np.full((len(column), len(vectors)), other)
    for dim in {len(v) for v in vectors}:
        which = [i for i, v in enumerate(vectors) if len(v) == dim]
        q = np.stack([vectors[i] for i in which])
        at, x = _rows(column, dim)
        p = x @ q.T
        if cosine:
            with np.errstate(invalid="ignore", divide="ignore"):
                p /= np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
        out[np.ix_(at, which)] = p
    if cosine:
        out[~np.asarray(column.is_valid())] = 0.0
        out[:, [i for i, v in enumerate(vectors) if (v * v).sum() < tiny * tiny]] = 0.0
        for dim in np.unique(column.value_lengths().drop_null().to_numpy(zero_copy_only=False)).tolist():
            at, x = _rows(column, dim)
            out[at[(x * x).sum(1) < tiny * tiny]] = 0.0
    return out


def matrix_scores(frames: DataFrame, queries: dict[str, Sequence[float]], keys: Sequence[str] = ("video_id", "frame_idx"), cosine: bool = False) -> DataFrame:
    """(keys, embedding) and query vectors -> (keys, query, score): (x + 1) / 2 within 0 and 1, x the dot product, or the ``cosine``.

    A row with a null component or of another length than the query scores 0; so does a null embedding, but with ``cosine``
    (a silent frame) it has 0.5. Nothing is shuffled; an embedding is read once for all queries.
    """
    schema = StructType([*(frames.schema[k] for k in keys), StructField("query", StringType()), StructField("score", DoubleType())])
    names, size, parts = list(queries), 0, [[]]
    for name in names:
        if size + 8 * len(queries[name]) > MOST_BYTES and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append(name)
        size += 8 * len(queries[name])
    out = None
    for part in parts:
        done = frames.select(*keys, "embedding").mapInArrow(_scored(part, [np.array(queries[n], float) for n in part], list(keys), cosine), schema)
        out = done if out is None else out.unionByName(done)
    return out


def _scored(names: list[str], vectors: list[np.ndarray], keys: list[str], cosine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, m = max(1, AT_ONCE // max(1, len(names))), len(names)
        for batch in batches:
            for first in range(0, len(batch) if m else 0, step):
                some = batch.slice(first, step)
                n = len(some)
                score = (_products(some["embedding"], vectors, cosine) + 1) / 2
                score = np.where(np.isnan(score), 1.0, np.clip(score, 0.0, 1.0)).ravel()  # NaN is the greatest, as in SQL
                each = pa.array(np.repeat(np.arange(n), m))
                yield pa.RecordBatch.from_arrays([*(some[k].take(each) for k in keys), pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(m), n))), pa.array(score)], names=[*keys, "query", "score"])

    return run


def with_cosines(rows: DataFrame, vectors: Sequence[Sequence[float]], column: str = "embedding", out: str = "cosines") -> DataFrame:
    """``rows`` with ``out``, the cosines of their vector with each of ``vectors`` in order (array<double>), in the place of ``column``.

    0 for null and zero vectors, those of another length or with null or non-finite values. Nothing is shuffled.
    """
    kept = [c for c in rows.columns if c != column]
    schema = StructType([*(rows.schema[c] for c in kept), StructField(out, ArrayType(DoubleType()))])
    given = [np.array(v, float) for v in vectors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, AT_ONCE // max(1, len(given)))
        for batch in batches:
            for first in range(0, len(batch), step):
                some = batch.slice(first, step)
                found = _products(some[column], given, True, other=0.0) if given else np.zeros((len(some), 0))
                found = np.where(np.isfinite(found), np.clip(found, -1.0, 1.0), 0.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(given)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(some[c] for c in kept), lists], names=[*kept, out])

    return rows.select(*kept, column).mapInArrow(run, schema)
