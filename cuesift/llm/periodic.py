"""Runs of repeated words in documents: a screen for places that may repeat, then tandem repeats.

A run is a stretch of words with smallest period p (words p apart are identical) that is at least
``exponent`` p words long and that no neighbouring word extends. All words of a run but the last p
occur again p words on, which a screen of the whole batch looks for first; what it leaves (stretches
of documents that hold every run whole) is one sequence for ``tandem_runs``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesift.llm.tandem import tandem_runs

LEAST, EXPONENT = 6, 4
#: Words (of all documents, of those that may have runs) and bytes that are handled together; a document is never parted.
SCREENED, SEARCHED, HELD = 1 << 18, 1 << 19, 64 << 20
#: Words that are taken together by the screen for longer periods.
GRAM = 8
_NEVER = np.int64(1) << 62
_STEP = np.int64(0x1E3779B97F4A7C15)

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Ids(dict):
    """Words -> numbers in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _distance(keys: np.ndarray) -> np.ndarray:
    """How far on each key occurs again."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), _NEVER)
    again = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def _stretches(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of True that are at least so long."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return a[long], b[long]


def screened(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of documents that hold every run whole: starts and ends, apart from each other.

    ``bounds`` are the documents' n + 1 bounds among the words. For periods of each power of two, words of a run (or ``GRAM`` words
    together, known by a hash: a collision only lets more through) must occur again within that distance, one after the other.
    """
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    most = int(np.diff(bounds).max(initial=0))
    key = doc * np.int64(int(ids.max(initial=0)) + 1) + ids
    found = []
    one, top = _distance(key), 1
    gram = None
    while exponent * (top // 2 + 1) <= most:
        low, m = top // 2 + 1, 1
        distance = one
        if low >= GRAM:
            if gram is None:
                h = key.copy()
                for j in range(1, GRAM):
                    h[:-j] = h[:-j] * _STEP + key[j:]
                gram = _distance(h)
            distance, m = gram, GRAM
        need = max((exponent - 1) * low, least - top) - (m - 1)
        a, b = _stretches(distance <= top, need)
        found.append(np.stack([a, b + (m - 1) + top], 1))
        top *= 2
    if not found or not len(found := np.concatenate(found)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = found[np.argsort(found[:, 0], kind="stable")]
    start, end = found[:, 0], np.minimum(found[:, 1], bounds[doc[found[:, 0]] + 1])
    reach = np.maximum.accumulate(end)
    head = np.flatnonzero(np.concatenate([[True], start[1:] >= reach[:-1]]))
    return start[head], reach[np.append(head[1:], len(start)) - 1]


def runs_of(ids: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, ...]:
    """Runs of the stretches: document, place of the start in it, length, period; by document, start and period."""
    length = end - start
    off = np.cumsum(length + 1) - (length + 1)
    t = np.empty(int((length + 1).sum()), np.int64)
    # a number that nothing else has ends each stretch
    t[off + length] = int(ids.max(initial=0)) + 1 + np.arange(len(start))
    owner = np.repeat(np.arange(len(start)), length)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    t[off[owner] + place] = ids[start[owner] + place]
    a, b, period = tandem_runs(t, exponent)
    some = b - a >= least
    a, b, period = a[some], b[some], period[some]
    stretch = np.searchsorted(off, a, "right") - 1
    at = a - off[stretch] + start[stretch]
    doc = np.searchsorted(bounds, at, "right") - 1
    order = np.lexsort((period, at, doc))
    return doc[order], (at - bounds[doc])[order], (b - a)[order], period[order]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words aren't beyond the first period of any run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:-1] == 0


class _Part:
    """Documents whose words wait for the search."""

    def __init__(self, least: int, exponent: int):
        self.least, self.exponent = least, exponent
        self.ids: list[np.ndarray] = []  # of all documents since the last screen
        self.words: list[list[bytes]] = []
        self.number, self.size, self.held = _Ids(), 0, 0

    def add(self, text: bytes | None) -> None:
        words = (text or b"").split()
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.words.append(words)
        self.size += len(words)
        self.held += len(text or b"")

    def full(self) -> bool:
        return self.size >= SCREENED or self.held >= HELD

    def results(self) -> tuple[list[list[dict]], list[bytes]]:
        """Runs and remaining text of each document, in order."""
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype(np.int64)
        ids = np.concatenate([*self.ids, np.zeros(0, np.int64)])
        a, b = screened(ids, bounds, self.least, self.exponent)
        own = [np.zeros((0, 3), np.int64)] * len(self.ids)
        at = 0
        size = np.cumsum(b - a)
        while at < len(a):  # the search takes so many words at a time, whole stretches
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SEARCHED, "right")))
            doc, *rest = runs_of(ids, bounds, a[at:end], b[at:end], self.least, self.exponent)
            rows = np.stack(rest, 1)
            which, first = np.unique(doc, return_index=True)
            for d, x in zip(which.tolist(), np.split(rows, first[1:]) if len(which) else [], strict=True):
                own[d] = np.concatenate([own[d], x])
            at = end
        runs = [[{"start": s, "length": n, "period": p} for s, n, p in x.tolist()] for x in own]
        left = [b" ".join(w if not len(x) else [w[i] for i in np.flatnonzero(_kept(len(w), x)).tolist()]) for w, x in zip(self.words, own, strict=True)]
        self.__init__(self.least, self.exponent)
        return runs, left


def _search(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            part, done = _Part(least, exponent), 0
            for i in range(len(batch)):
                part.add(texts[i].as_py())
                if part.full() or i + 1 == len(batch):
                    words = [len(x) for x in part.ids]
                    runs, left = part.results()
                    ids = batch["doc_id"].slice(done, i + 1 - done)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(runs, _RUNS), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
                    done = i + 1

    return run


def word_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Runs of repeated words of each document, and its text without their repeats.

    A row per row: doc_id, n_words, runs (array of start, length, period in words, by start, then period) of at least
    ``least`` words and ``exponent`` (2 or more) periods, collapsed (the words that no run contains after its first
    period, joined by one blank). Words are what space and the bytes 9 to 13 part; they are equal if their bytes are.

    Only doc_id and text are read; other columns may have any names. A null or empty text has no words, no runs and an
    empty ``collapsed``. Rows are independent: repeated rows give equal rows, a null doc_id is returned as it is. An
    empty table gives no rows. A document is handled whole by one task, in time n log n and memory in proportion to its words.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_search(least, exponent), "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch["text"].cast(pa.binary())
        ids = batch["doc_id"].to_pylist()
        change = {i: h // 10 for i, x in enumerate(ids) if x is not None and (h := zlib.crc32(str(x).encode())) % 10 == 0}
        done = 0
        for i, g in change.items():
            words = (text[i].as_py() or b"").split()
            if not words:
                continue
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            new = b" ".join(words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a])
            if i > done:
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(done, i - done), batch["text"].slice(done, i - done)], names=["doc_id", "text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, 1), pa.array([new], pa.binary()).cast(pa.string())], names=["doc_id", "text"])
            done = i + 1
        if done < len(batch):
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(done), batch["text"].slice(done)], names=["doc_id", "text"])


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the documents (by the CRC of doc_id) made periodic from some word on.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10): if h % 10 = 0, each word i from a = g % n on becomes word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Documents without an id or without words stay.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_planted, "doc_id bigint, text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """The query's columns: number of runs, the longest of them, digests of all runs and of the collapsed text."""
    found = word_runs(planted_periods(docs), LEAST, EXPONENT)
    # greatest length first, then smallest start, then smallest period
    best = F.expr("array_min(transform(runs, x -> named_struct('n', -x.length, 'start', x.start, 'period', x.period)))")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("b.n")
    return out.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"), F.expr("(1000 * -b.n) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
