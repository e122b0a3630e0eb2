"""Byte-level BPE over a global distinct-word shuffle.

Texts are cut into pre-tokens; a chunk of documents keeps its distinct pre-tokens
once and each document as positions among them. The chunks' words are exploded with
their positions and shuffled by word, so every distinct word meets in one place and
is encoded once; the ids go back by chunk, where documents are
reassembled by position. A frequent word costs one row per chunk, not one per
occurrence, so no word is hot. Decoding looks every id up in the token-byte table,
which is as large as the vocabulary file.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from cuesift.llm.packed import pack, unpack, unpack_parts

#: Distinct pre-tokens at which a chunk is closed (after the document that reaches it).
CHUNK_WORDS = 400_000
#: Bytes of places (four a pre-token) at which a chunk is closed, however few its distinct words.
CHUNK_BYTES = 48_000_000
#: Words whose ids a task gathers by chunk before it passes them on.
GATHERED = 500_000
#: A chunk's number and a word's place in it share a long.
_PLACE_BITS = 31
#: Ids that are decoded at once.
DECODED = 1 << 16

_tables: dict[bytes, object] = {}
_token_bytes: dict[bytes, list[bytes]] = {}


def read_ranks(path: str) -> bytes:
    """A tiktoken vocabulary file's bytes, read once on the driver (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


#: A word of more bytes is merged with a heap.
SHORT = 64


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: of all neighbours the pair of least rank is merged (the first of equals), until none has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SHORT:
        return _merged_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    never = len(ranks) + (1 << 40)
    pairs = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (least := min(pairs)) < never:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], never)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
    return [ranks[p] for p in parts]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merged`` in n log n steps: pairs wait in a heap by rank and place; those whose ends have changed are passed over."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if after[i] < n and (rank := ranks.get(word[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[after[i]]))

    for i in range(n):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, reach = heapq.heappop(heap)
        if gone[i] or after[i] >= n or end[after[i]] != reach:
            continue
        j = after[i]
        gone[j], end[i], after[i] = 1, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def _encoder(raw: bytes):
    """word -> ids, its table made once in a Python worker."""
    key = hashlib.sha256(raw).digest()
    if key not in _tables:
        _tables[key] = _ranks(raw)
    ranks = _tables[key]
    return lambda word: merged(word, ranks)


def token_bytes(raw: bytes) -> list[bytes]:
    """The token-byte table by id; ids without a token have no bytes."""
    ranks = _ranks(raw)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _stream(**columns: pa.Array) -> bytes:
    """Columns as compressed Arrow bytes."""
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _restored(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _chunks(pattern: str, most: int, id_type: pa.DataType):
    """doc_id, text -> one row per chunk: number, documents (ids and token counts), packed places, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        first = number = TaskContext.get().partitionId() << 12
        ids, counts, places, words, size = [], [], [], {}, 0

        def closed() -> pa.RecordBatch:
            docs = _stream(doc_id=pa.array(ids, id_type), count=pa.array(counts, pa.int64()))
            values = (docs, _squeezed(b"".join(places)), _stream(word=pa.array(list(words), pa.large_string())))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], names=["chunk", "docs", "places", "words"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = find(text.as_py() or "")
                for word in found:
                    words.setdefault(word, len(words))
                ids.append(doc_id.as_py())
                counts.append(len(found))
                places.append(pack(np.fromiter(map(words.__getitem__, found), np.int64, len(found))))
                size += 4 * len(found)
                if len(words) >= most or len(ids) >= 100_000 or size >= CHUNK_BYTES:
                    yield closed()
                    if (number := number + 1) >= first + (1 << 12):
                        raise ValueError("a partition has more chunks than numbers; deal the input to more partitions")
                    ids, counts, places, words, size = [], [], [], {}, 0
        if ids:
            yield closed()

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks -> a row per distinct word of each: its place (chunk and index) and itself."""
    for batch in batches:
        for chunk, data in zip(batch["chunk"].to_pylist(), batch["words"], strict=True):
            words = _table(data.as_py())["word"].combine_chunks()
            place = np.arange(len(words), dtype=np.int64) + (chunk << _PLACE_BITS)
            for at in range(0, len(words), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(place[at : at + 10_000]), words.slice(at, 10_000).cast(pa.string())], names=["place", "word"])


def _encoded(raw: bytes):
    """place, word (sorted by word) -> a row per chunk met: gaps between places, ids' numbers, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, ids = _encoder(raw), None, b""
        places, out = [], []

        def gathered() -> Iterator[pa.RecordBatch]:
            place = np.concatenate(places)
            order = np.argsort(place)
            place = place[order]
            chunk, index = place >> _PLACE_BITS, place & ((1 << _PLACE_BITS) - 1)
            edge = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part = [out[i] for i in order[a:b].tolist()]
                values = (pack(np.diff(index[a:b], prepend=0)), pack(np.fromiter(map(len, part), np.int64, b - a) // 4), b"".join(part))
                yield pa.RecordBatch.from_arrays([pa.array([chunk[a]], pa.int64()), *[pa.array([_squeezed(v)], pa.binary()) for v in values]], names=["chunk", "gaps", "sizes", "ids"])

        for batch in batches:
            places.append(batch["place"].to_numpy())
            for word in batch["word"].to_pylist():
                if word != last:
                    last, ids = word, np.array(encode(word.encode()), "<u4").tobytes()
                out.append(ids)
            if len(out) >= GATHERED:
                yield from gathered()
                places, out = [], []
        if out:
            yield from gathered()

    return run


def _ids_by_place(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a chunk's words: all in one array, and by place each word's start in it and its number of ids."""
    places, sizes, ids = [], [], []
    for i in range(found.num_rows):
        gaps, lens, data = (_restored(found[name][i].as_py()) for name in ("gaps", "sizes", "ids"))
        places.append(np.cumsum(unpack(gaps)).astype(np.int32))
        sizes.append(unpack(lens).astype(np.int32))
        ids.append(np.frombuffer(data, "<u4"))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")
    place, size = np.concatenate(places), np.concatenate(sizes)
    starts, lens = np.zeros(len(place), np.int64), np.zeros(len(place), np.int32)
    starts[place], lens[place] = np.cumsum(size, dtype=np.int64) - size, size
    return starts, lens, np.concatenate(ids)


def _documents(chunk: pa.Table, found: pa.Table) -> Iterator[tuple[object, bytes]]:
    """A chunk and its words' ids -> each document's id and its token ids as bytes, by position.

    Words' ids stay one array and places are unpacked part by part: neither is an object for each word or occurrence.
    """
    starts, lens, flat = _ids_by_place(found)
    for i in range(chunk.num_rows):
        docs = _table(chunk["docs"][i].as_py())
        parts = unpack_parts(_restored(chunk["places"][i].as_py()))
        rest = np.zeros(0, np.int64)
        for doc_id, n in zip(docs["doc_id"], docs["count"].to_numpy().tolist(), strict=True):
            ids = []
            while n:
                if not len(rest):
                    rest = next(parts)
                at, rest = rest[:n], rest[n:]
                n -= len(at)
                size = lens[at]
                end = np.cumsum(size, dtype=np.int64)
                ids.append(flat[np.repeat(starts[at] - end + size, size) + np.arange(end[-1])].tobytes())
            yield doc_id.as_py(), ids[0] if len(ids) == 1 else b"".join(ids)


def _digested(raw: bytes, id_type: pa.DataType):
    """A chunk and its words' ids -> a row per document: digests of ids and of what they decode to."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        key = hashlib.sha256(raw).digest()
        if key not in _token_bytes:
            _token_bytes[key] = token_bytes(raw)
        table = _token_bytes[key]
        out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for doc_id, ids in _documents(chunk, found):
            decoded = hashlib.sha256()
            for at in range(0, len(ids), 4 * DECODED):
                decoded.update(b"".join(map(table.__getitem__, np.frombuffer(ids[at : at + 4 * DECODED], "<u4").tolist())))
            for name, value in zip(out, (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()), strict=True):
                out[name].append(value)
        kinds = (id_type, pa.int64(), pa.string(), pa.string())
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds, strict=True)})

    return run


def _listed(id_type: pa.DataType):
    """A chunk and its words' ids -> doc_id, ids."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        rows = [(doc_id, np.frombuffer(ids, "<u4").astype(np.int32)) for doc_id, ids in _documents(chunk, found)]
        return pa.table({"doc_id": pa.array([r[0] for r in rows], id_type), "ids": pa.array([r[1] for r in rows], pa.list_(pa.int32()))})

    return run


def encode_words(docs: DataFrame, raw: bytes, pattern: str, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(chunks, ids): chunks of documents, and the ids of every chunk's words.

    Both read the same exchange of chunks by number, which Spark runs once: all its columns
    are taken on either side so that the exchanges stay equal. Lost shuffle files are made
    again from the documents.
    """
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    made = docs.select("doc_id", "text").mapInArrow(_chunks(pattern, chunk_words, kind), "chunk bigint, docs binary, places binary, words binary")
    chunks = made.repartition("chunk")
    words = chunks.mapInArrow(_exploded, "place bigint, word string")
    ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encoded(raw), "chunk bigint, gaps binary, sizes binary, ids binary")
    return chunks, ids


def encode(docs: DataFrame, raw: bytes, pattern: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, ids array<int>), a row per row of ``docs``. Cases as in ``round_trip``."""
    kind = docs.schema["doc_id"].dataType
    chunks, ids = encode_words(docs, raw, pattern, chunk_words)
    return chunks.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_listed(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, raw: bytes, pattern: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Encode every text, decode the ids, and return a digest of both per row of ``docs``.

    Columns: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (the decoded bytes). Only doc_id and text are read. Null and empty texts
    have no tokens; null and repeated doc_ids come back row by row; an empty table
    gives no rows; a very long text is one document of one chunk, read whole.
    """
    kind = docs.schema["doc_id"].dataType
    chunks, ids = encode_words(docs, raw, pattern, chunk_words)
    schema = f"doc_id {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return chunks.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_digested(raw, to_arrow_type(kind)), schema)


def decode(tokens: DataFrame, raw: bytes) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, bytes): each id's bytes, joined in order.

    Null ids (the array or one of it) add no bytes; an id outside the vocabulary fails.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(raw)
        for batch in batches:
            joined = [b"".join(table[i] for i in ids or () if i is not None) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(joined, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")
