"""Labelled samples, split by document id, for the two classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows, and bytes of their texts, that a classifier is fitted on.
MAX_ROWS, MAX_BYTES = 8_000, 48_000_000


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def _sampled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int) -> DataFrame:
    """(text, y) of at most ``max_rows`` labelled documents outside fold 2 of 4, whole texts, in one sorted partition.

    Labels meet their documents first; of rows that repeat an id with one label the shortest text counts, once. They are
    taken in the order of a hash of the id, at most ``max_rows``; a text that would
    go beyond ``max_bytes`` is passed over and shorter ones after it are still taken. So the sample is bounded
    at any size of input, repeated ids and long texts included. Null labels are left out.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null").where(fold(F.col("doc_id"), 4) != 2).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.struct(F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"))
    met = texts.select("doc_id", size.alias("s")).join(rows, "doc_id").groupBy("doc_id", "y").agg(F.min("s").alias("s")).select("doc_id", "y", "s.*")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y")]
    total, chosen = 0, []
    for row in met.where(F.col("n") <= max_bytes).orderBy(*order).limit(max_rows).collect():  # ids and sizes, max_rows of them
        if total + row["n"] <= max_bytes:
            total += row["n"]
            chosen.append((row["doc_id"], row["y"], row["n"], row["h"]))
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, met.schema))
    got = texts.withColumns({"n": F.octet_length("text").cast("long"), "h": F.xxhash64("text")}).join(few, ["doc_id", "n", "h"])
    return got.groupBy("doc_id", "y").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions(*order).select("text", "y")


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """The sample's (text, label)."""
    return [(row["text"], row["y"]) for row in _sampled(docs, labels, label, max_rows, max_bytes).collect()]


def fitted(docs: DataFrame, labels: DataFrame, label: str, fit: Callable[[list[tuple[str, int]]], object], max_rows: int, max_bytes: int) -> object:
    """``fit`` of the sample, run in one task on an executor; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [pair for batch in batches for pair in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(examples))], pa.binary())], names=["model"])

    found = _sampled(docs, labels, label, max_rows, max_bytes).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])
