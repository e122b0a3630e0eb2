"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

NB-SVM after Wang and Manning (2012), with a logistic loss: a text is the set of its
hashed byte n-grams (n = 3, 4, 5; A-Z as a-z); each feature is scaled by the log ratio of its
smoothed document counts in the two classes; weights are fitted with an L2 penalty.
Only the features that tell the classes apart best get a weight, so a model is
small and scoring looks at few positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cuesift.llm.labelled import MAX_BYTES, MAX_ROWS, fitted, fold
from cuesift.llm.words import PIECE, is_long, pieces

ORDERS = (3, 4, 5)
BITS = 20
FEATURES = 1024
#: Bytes of text that a fit looks at together.
FIT_PIECE = 1 << 18
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    """``slot`` maps a feature hash to its weight's place, -1 without one."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def _hits(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None) -> np.ndarray:
    """Sorted distinct (text << BITS | n-gram hash) of a run of texts, of chosen hashes only."""
    if is_long(data, offsets):
        parts = [data[a : a + PIECE + max(ORDERS) - 1] for a in range(0, len(data), PIECE)]
        return np.unique(np.concatenate([_hits(part, np.array([0, len(part)]), chosen) for part in parts]))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    low = _LOWER[data] + np.uint32(1)
    found, h = [], low.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(low) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + low[n - 1 :]
        if n in ORDERS:
            k = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            k >>= np.uint32(32 - BITS)
            use = text[: len(k)] == text[n - 1 :]
            use = np.flatnonzero(use if chosen is None else use & chosen[k])
            found.append(text[use] << BITS | k[use])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def fit(examples: list[tuple[str, int]], features: int = FEATURES, l2: float = 3.0, steps: int = 20) -> Model:
    """The model of (text, 0 or 1) examples; without both classes it is constant."""
    y = np.array([label for _, label in examples], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), 4.0 if len(y) and y[0] else -4.0)
    count = np.zeros((2, 1 << BITS), np.float32)
    column = pa.array([text for text, _ in examples], pa.large_string())
    for start, _, data, offsets in pieces(column, FIT_PIECE):
        hit = _hits(data, offsets, None)
        for c in (0, 1):
            count[c] += np.bincount(hit[y[start + (hit >> BITS)] == c] & ((1 << BITS) - 1), minlength=1 << BITS)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    # the likelihood ratio of presence and class picks the features
    total = count.sum(0)
    gain = np.zeros(1 << BITS)
    for c in (0, 1):
        for there, of in ((count[c], total), (n[c] - count[c], n.sum() - total)):
            expect = of * (n[c] / n.sum())
            gain += np.where(there > 0, there * np.log(np.maximum(there, 1e-9) / np.maximum(expect, 1e-9)), 0)
    gain[total < 3] = 0
    best = np.sort(np.argsort(-gain, kind="stable")[:features])
    best = best[gain[best] > 0]
    ratio = np.log((count[1, best] + 1) / (n[1] + 2)) - np.log((count[0, best] + 1) / (n[0] + 2))
    x = np.zeros((len(y), len(best) + 1), np.float32)
    x[:, -1] = 1
    chosen, place = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32)
    chosen[best], place[best] = True, np.arange(len(best))
    for start, _, data, offsets in pieces(column, FIT_PIECE):
        hit = _hits(data, offsets, chosen)
        at = place[hit & ((1 << BITS) - 1)]
        x[start + (hit >> BITS), at] = ratio[at]
    w = _newton(x, y, l2, steps)
    w, b = w[:-1], w[-1]
    return Model(best, (w * ratio).astype(np.float64), float(b))


def _newton(x: np.ndarray, y: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Logistic weights (the last column is the bias, unpenalised): Newton steps by conjugate gradients."""
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    loss = lambda w: np.logaddexp(0, z := x @ w.astype(np.float32)).sum() - y @ z + (penalty * w * w).sum() / 2
    w = np.zeros(x.shape[1])
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w.astype(np.float32)).astype(np.float64)))
        left = -((p - y).astype(np.float32) @ x + penalty * w)
        curve, move, to = (p * (1 - p)).astype(np.float32), np.zeros_like(w), left.copy()
        size = first = left @ left
        for _ in range(60):
            if size <= 1e-4 * first:
                break
            bent = ((x @ to.astype(np.float32)) * curve) @ x + penalty * to
            far = size / (to @ bent)
            move, left = move + far * to, left - far * bent
            before, size = size, left @ left
            to = left + size / before * to
        step = 1.0
        while (new := loss(w + step * move)) > now and step > 1e-3:
            step /= 2
        done = now - new < 1e-5 * max(1.0, abs(now))
        w, now = w + step * move, new
        if done:
            break
    return w


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """The probability of label 1 for every text, whole; null and empty texts get the bias."""
    weight, chosen = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
    weight[model.hashes], chosen[model.hashes] = model.weights, True
    out = np.zeros(len(column))
    for start, end, data, offsets in pieces(column):
        hit = _hits(data, offsets, chosen)
        out[start:end] = np.bincount(hit >> BITS, weight[hit & ((1 << BITS) - 1)], minlength=end - start)
    return 1 / (1 + np.exp(-(out + model.bias)))


def with_score(docs: DataFrame, score, name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` from ``score(text column)``, in one pass."""
    keep = [c for c in docs.columns if c.lower() != name.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(batch["text"]), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model of ``labels.toxic``, fitted on a bounded sample outside fold 2 of 4."""
    return fitted(docs, labels, "toxic", fit, max_rows, max_bytes)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """Score every document: ``docs`` with score in [0, 1] and predicted (score >= threshold).

    One pass without a shuffle. Scores come from the text alone; ids only decide which labels
    may be learnt (crc32 of the id modulo 4 other than 2). Null text scores as
    empty, null ids are scored too, repeated rows score alike, very long texts
    are read whole, an empty table gives no rows; without labels of both classes
    every text gets one constant score. Input columns named score or predicted are replaced.
    """
    model = train(docs, labels, **bounds)
    scored = with_score(docs, lambda column: score_texts(column, model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id):
    """Whether labels of the document are kept from learning."""
    return fold(doc_id, 4) == 2
