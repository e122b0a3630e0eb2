"""Training-order materialisation: token sequences at permuted slots of fixed-stride shards.

A keyed Feistel network over the least even number of bits that holds N, walked along its cycle
until it lands below N, is a permutation of 0..N-1: it gives every sequence its global slot
without a sort or a table. Slot s is at byte (s mod shard length) * stride of shard s div length,
so a reader goes on at any slot with one seek. Slots are dealt by range: a partition holds neighbouring shards, puts one
at a time in order and writes it; a shard's file appears at once and is the same at every attempt.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cuesift.llm.bpe import encode
from cuesift.llm.storage import shared_dir, written
from cuesift.llm.words import mix, pieces

LENGTH = 512
SHARD_SEQUENCES = 16_384
ROUNDS = 6
#: Most range partitions; with more shards each writes several, one after the other.
MOST_PARTITIONS = 100_000


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of ``index`` (0 to n - 1) under the keyed permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << np.uint64(half) | right

    out = once(np.asarray(index).astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:  # less than four steps on average
        out[far] = once(out[far])
    return out.astype(np.int64)


def unpermuted(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse of ``permuted``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left + k) & mask), left
        return left << np.uint64(half) | right

    out = once(np.asarray(slot).astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


#: Bytes of sequences that a task gathers before it passes them on by shard.
GATHERED = 32_000_000


def _packed(rows: list[pa.RecordBatch], per_shard: int) -> Iterator[pa.RecordBatch]:
    """Gathered sequences -> a row per shard: its number and its sequences as compressed Arrow bytes."""
    table = pa.Table.from_batches(rows).sort_by("slot")
    shard = table["slot"].to_numpy() // per_shard
    edge = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.slice(a, b - a).combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([shard[a]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["shard", "body"])


def _cut(first: Broadcast, total: int, key: int, stride: int, width: int, per_shard: int):
    """doc_id, ids (bytes) -> sequences with their slots, packed by shard; ``first`` has each partition's first index and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, starts, counts = first.value
        place = int(np.searchsorted(parts, TaskContext.get().partitionId()))
        known = place < len(parts) and parts[place] == TaskContext.get().partitionId()
        at, count = (int(starts[place]), int(counts[place])) if known else (0, 0)
        end, rows, held = at + count, [], 0
        for batch in batches:
            for a, b, data, offsets in pieces(batch["ids"]):
                size = np.diff(offsets)
                n = np.maximum(1, -(-size // stride))
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = offsets[:-1][doc] + piece * stride
                length = np.minimum(stride, offsets[1:][doc] - start)
                body = np.zeros((len(doc), stride), np.uint8)
                column = np.arange(stride)[None, :]
                inside = column < length[:, None]
                body[inside] = data[(start[:, None] + column)[inside]]
                slot = permuted(at + np.arange(len(doc)), total, key)
                at += len(doc)
                held += body.size
                rows.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array(slot), batch["doc_id"].slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array((length // width).astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), len(doc), [None, pa.py_buffer(body)])],
                        names=["slot", "doc_id", "piece", "n_tokens", "ids"],
                    )
                )
                if held >= GATHERED:
                    yield from _packed(rows, per_shard)
                    rows, held = [], 0
        if rows:
            yield from _packed(rows, per_shard)
        if at != end:
            raise ValueError("the input's partitions changed between counting and cutting; give a table that reads alike each time")

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(path: str, per_shard: int, stride: int, id_type: pa.DataType):
    """Sequences packed by shard, shards in order -> their files, and a directory row for each, checked against the file."""

    def shard_of(bodies: list[bytes]) -> pa.Table:
        table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in bodies]).sort_by("slot")
        slot = table["slot"].to_numpy()
        shard = int(slot[0]) // per_shard
        base = shard * per_shard
        if slot[0] != base or (np.diff(slot) != 1).any():
            raise ValueError(f"shard {shard} isn't whole")
        store, folder = fs.FileSystem.from_uri(path)
        name = f"{folder}/{shard_name(shard)}"
        store.create_dir(folder, recursive=True)
        part = f"{folder}/.{shard_name(shard)}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(part) as out:
            for chunk in table["ids"].to_pylist():
                out.write(chunk)
        store.move(part, name)  # a repeated attempt puts the same bytes there
        with store.open_input_file(name) as file:
            data = file.read()
        crc = [zlib.crc32(data[i : i + stride]) for i in range(0, len(data), stride)]
        return pa.table({"slot": table["slot"], "shard": pa.array(np.full(len(slot), shard, np.int32)), "byte_offset": pa.array((slot - base) * stride), "doc_id": table["doc_id"].cast(id_type), "piece": table["piece"], "n_tokens": table["n_tokens"], "crc32": pa.array(crc, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies = None, []
        for batch in batches:
            for shard, body in zip(batch["shard"].to_pylist(), batch["body"], strict=True):
                if bodies and shard != now:
                    yield from shard_of(bodies).to_batches()
                    bodies = []
                now = shard
                bodies.append(body.as_py())
        if bodies:
            yield from shard_of(bodies).to_batches()

    return run


def byte_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, ids): a text's UTF-8 bytes as its token ids, one byte each; null is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("ids"))


def bpe_ids(docs: DataFrame, raw: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids): a text's byte-level BPE ids, four bytes each, in a written table as ``materialise`` needs it (width 4)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(x or [], "<u4").tobytes() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return written(encode(docs, raw, pattern).mapInArrow(run, f"doc_id {kind.simpleString()}, ids binary"), "ids")


def materialise(sequences: DataFrame, path: str, key: int = 1, length: int = LENGTH, width: int = 1, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """Write documents' token ids as shards in training order; return the shards' directory.

    ``sequences``: doc_id, and ids as bytes (string or binary) of ``width`` bytes per token. Each document is
    cut into sequences of ``length`` tokens, the last filled with zeros; a document without tokens
    has one empty sequence. Returns a row per sequence: slot, shard, byte_offset, doc_id, piece,
    n_tokens, crc32 of its stored bytes, filler included, as read back from the file. Evaluating the
    result writes the files; doing so again writes the same ones.

    Indices follow the input's partitions, which are counted first: the input has to be a scan
    of files (or a written table), and a task fails if it meets other rows than were
    counted. The counts (24 bytes for each file split) are broadcast. Tasks hold one shard at a time. Null ids and repeated rows are sequences like others; null
    texts are empty; other columns aren't read; an empty table writes nothing.
    """
    stride = length * width
    src = sequences.select("doc_id", "ids")
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("ids"), F.lit(0)) / stride))
    counts = src.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(n).alias("n")).collect()  # a row per file split
    parts, each = (np.array(x, np.int64) for x in (zip(*sorted((r["p"], r["n"]) for r in counts), strict=True) if counts else ([], [])))
    total = int(each.sum())
    first = sequences.sparkSession.sparkContext.broadcast((parts, np.cumsum(each) - each, each))
    kind = src.schema["doc_id"].dataType
    cut = src.mapInArrow(_cut(first, total, key, stride, width, per_shard), "shard bigint, body binary")
    out = f"slot bigint, shard int, byte_offset bigint, doc_id {kind.simpleString()}, piece int, n_tokens int, crc32 bigint"
    shard_count = max(1, -(-total // per_shard))
    ranges = min(shard_count, MOST_PARTITIONS)
    dealt = cut.repartitionById(ranges, F.floor(F.col("shard") * ranges / shard_count).cast("int")).sortWithinPartitions("shard")
    return dealt.mapInArrow(_write(path, per_shard, stride, to_arrow_type(kind)), out)


def training_order(docs: DataFrame, key: int = 1, length: int = LENGTH, per_shard: int = SHARD_SEQUENCES, path: str | None = None) -> DataFrame:
    """Shards of the documents' byte ids and their directory, with the folder that holds them in the column ``path``.

    Without ``path`` that is a new folder of the shared store. The files are the caller's: they stay when the session ends, and
    ``read_from(path, slot)`` reads on from any slot.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/cuesift-shards-{uuid.uuid4().hex}"
    return materialise(byte_ids(docs), path, key, length, 1, per_shard).withColumn("path", F.lit(path))


def read_from(path: str, slot: int, length: int = LENGTH, width: int = 1, per_shard: int = SHARD_SEQUENCES) -> Iterator[tuple[int, bytes]]:
    """(slot, stored bytes) from a slot on to the last, one seek and then in sequence."""
    store, folder = fs.FileSystem.from_uri(path)
    stride = length * width
    while True:
        name = f"{folder}/{shard_name(slot // per_shard)}"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            return
        with store.open_input_file(name) as file:
            file.seek(slot % per_shard * stride)
            while chunk := file.read(stride):
                yield slot, chunk
                slot += 1
        if slot % per_shard:
            return


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard files as (path, content), for a job over all of them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path).select("path", "content")
