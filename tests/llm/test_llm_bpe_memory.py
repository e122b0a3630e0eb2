from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cuesift.llm import bpe
from cuesift.llm.packed import pack, unpack, unpack_parts

RAW = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.mark.parametrize("part", [1, 2, 7, 1 << 18])
def test_parts_are_the_whole(part):
    values = np.random.default_rng(1).integers(0, 1 << np.random.default_rng(2).integers(1, 40, 500))
    assert np.concatenate(list(unpack_parts(pack(values), part))).tolist() == unpack(pack(values)).tolist() == values.tolist()
    assert list(unpack_parts(b"", part)) == []


def test_a_chunk_is_put_together_part_by_part():
    """What a chunk takes beside its bytes is its words' ids as arrays, not an object for each word or eight bytes for each occurrence."""
    rng = np.random.default_rng(5)
    words, counts = 100_000, [0, 900_000, 1, 0, *[60] * 10_000]
    at = rng.integers(0, words, sum(counts))
    at[:words] = rng.permutation(words)
    sizes = rng.integers(1, 5, words)
    ids = rng.integers(0, 50_000, sizes.sum()).astype("<u4")
    ends = np.cumsum(sizes)
    docs = bpe._stream(doc_id=pa.array(range(len(counts)), pa.int64()), count=pa.array(counts, pa.int64()))
    chunk = pa.table({"chunk": [7], "docs": pa.array([docs], pa.binary()), "places": pa.array([bpe._squeezed(pack(at))], pa.binary())})
    half = rng.permutation(words) < words // 2  # two tasks have encoded the words
    found = []
    for some in (np.flatnonzero(half), np.flatnonzero(~half)):
        its = b"".join(ids[ends[i] - sizes[i] : ends[i]].tobytes() for i in some.tolist())
        found.append([bpe._squeezed(x) for x in (pack(np.diff(some, prepend=0)), pack(sizes[some]), its)])
    found = pa.table({"chunk": [7, 7], **{name: pa.array([f[k] for f in found], pa.binary()) for k, name in enumerate(("gaps", "sizes", "ids"))}})
    run = bpe._digested(RAW, pa.int64())
    run(chunk.slice(0, 0), found)  # the token table is made
    tracemalloc.start()
    got = run(chunk, found).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tokens, first = bpe.token_bytes(RAW), 0
    assert len(got["doc_id"]) == len(counts)
    for i, n in list(enumerate(counts))[:300]:
        mine = np.concatenate([ids[:0], *(ids[ends[w] - sizes[w] : ends[w]] for w in at[first : first + n].tolist())])
        first += n
        assert (got["doc_id"][i], got["n_tokens"][i], got["ids_sha256"][i]) == (i, len(mine), hashlib.sha256(mine.tobytes()).hexdigest())
        assert got["decoded_sha256"][i] == hashlib.sha256(b"".join(tokens[t] for t in mine.tolist())).hexdigest()
    assert peak < 45_000_000, peak
