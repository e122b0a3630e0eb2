from __future__ import annotations

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cuesift.llm import matroska as M
from cuesift.llm import shards, storage
from cuesift.llm.queries import queries

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
ODD = [(1, None), (2, ""), (3, "\x00"), (None, "a null id"), (4, "x" * 200_000), (4, "x" * 200_000), (5, "ünï 中文 👍"), (6, "y" * 512), (7, "y" * 513)]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**64 - 1))
def test_the_permutation_is_one_and_is_inverted(n, key):
    slots = shards.permuted(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    assert (shards.unpermuted(slots, n, key) == np.arange(n)).all()


def test_the_permutation_depends_on_its_key_and_mixes():
    n = 10_000
    a, b = shards.permuted(np.arange(n), n, 1), shards.permuted(np.arange(n), n, 2)
    assert (a == b).mean() < 0.01 and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.05


def test_shards_of_bpe_ids_in_few_range_partitions(spark, tmp_path, monkeypatch):
    import public_tokenizers
    import tiktoken

    from cuesift.llm import bpe

    raw = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(raw), special_tokens={})
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()] + [(None, None), (-1, "")]
    monkeypatch.setattr(shards, "MOST_PARTITIONS", 3)
    ids = shards.bpe_ids(spark.createDataFrame(rows, SCHEMA), raw, public_tokenizers.PATTERN)
    path = f"file://{tmp_path}/shards"
    out = shards.materialise(ids, path, 9, 16, 4, 50).collect()
    stored, got = dict(shards.read_from(path, 0, 16, 4, 50)), {}
    assert sorted(r.slot for r in out) == list(range(len(out))) == sorted(stored) and len({r.shard for r in out}) > 3
    for r in sorted(out, key=lambda r: r.piece):
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(stored[r.slot][: 4 * r.n_tokens], "<u4").tolist()
    assert got == {i: encoding.encode_ordinary(t or "") for i, t in rows}


@pytest.mark.parametrize(("length", "per_shard"), [(512, 16_384), (64, 7), (16, 1000)])
def test_shards_hold_every_document(spark, tmp_path, length, per_shard):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    src = tmp_path / "in"
    spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("clash")).repartition(3).write.parquet(f"file://{src}")
    path = f"file://{tmp_path}/shards"
    docs = spark.read.parquet(f"file://{src}")
    out = shards.materialise(shards.byte_ids(docs), path, 5, length, 1, per_shard).collect()
    n = sum(max(1, -(-len((t or "").encode()) // length)) for _, t in rows)
    assert sorted(r.slot for r in out) == list(range(n))
    stored = dict(shards.read_from(path, 0, length, 1, per_shard))
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        body = stored[r.slot]
        assert len(body) == length and zlib.crc32(body) == r.crc32 and body[r.n_tokens :].strip(b"\x00") == b""
        assert (r.shard, r.byte_offset) == (r.slot // per_shard, r.slot % per_shard * length)
        got[r.doc_id] = got.get(r.doc_id, b"") + body[: r.n_tokens]
    assert got == {i: (t or "").encode() for i, t in rows}
    middle = n // 2
    assert [s for s, _ in shards.read_from(path, middle, length, 1, per_shard)] == list(range(middle, n))
    before = {f: (tmp_path / "shards" / f).read_bytes() for f in os.listdir(tmp_path / "shards") if f.endswith(".bin")}
    shards.materialise(shards.byte_ids(docs), path, 5, length, 1, per_shard).collect()
    assert {f: (tmp_path / "shards" / f).read_bytes() for f in before} == before
    assert shards.read_shards(spark, path).count() == len(before)


def test_shards_of_odd_documents(spark, tmp_path):
    spark.createDataFrame(ODD, SCHEMA).write.parquet(f"file://{tmp_path}/in")
    docs = spark.read.parquet(f"file://{tmp_path}/in")
    out = shards.training_order(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, t in ODD for _ in range(max(1, -(-len((t or "").encode()) // 512))))
    assert shards.training_order(docs.where("doc_id > 1000")).count() == 0


def test_another_process_reads_on_from_a_slot(spark, tmp_path):
    """The query says where its shards are, and they are there for a process that knows nothing of the session."""
    spark.createDataFrame([(i, f"text {i} " * (i % 90)) for i in range(200)], SCHEMA).write.parquet(f"file://{tmp_path}/in/documents.parquet")
    rows = sorted(queries()["op5_training_order"](spark, f"file://{tmp_path}/in").collect(), key=lambda r: r.slot)
    (path,) = {r.path for r in rows}
    assert path not in {at for _, at in storage._written}
    code = f"import zlib; from cuesift.llm.shards import read_from; print([(s, zlib.crc32(b)) for s, b in read_from({path!r}, 37)])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert eval(out.stdout) == [(r.slot, r.crc32) for r in rows if r.slot >= 37] and len(rows) > 100


def test_changed_partitions_are_noticed(spark, tmp_path):
    first = spark.sparkContext.broadcast((np.array([0]), np.array([0]), np.array([5])))  # partition 0 starts at 0 with 5
    run = shards._cut(first, 5, 1, 8, 1, 4)
    with pytest.raises(Exception, match="changed"):
        spark.createDataFrame([(1, "abc")], "doc_id long, ids string").coalesce(1).mapInArrow(run, "shard bigint, body binary").collect()


def test_feistel_shards_of_wider_ids(spark, tmp_path):
    ids = np.arange(70_000, 70_100, dtype="<u4").tobytes()
    spark.createDataFrame([(1, ids)], "doc_id long, ids binary").write.parquet(f"file://{tmp_path}/in")
    path = f"file://{tmp_path}/s"
    out = shards.materialise(spark.read.parquet(f"file://{tmp_path}/in"), path, 1, 32, 4, 3).collect()
    stored = dict(shards.read_from(path, 0, 32, 4, 3))
    back = b"".join(stored[r.slot][: r.n_tokens * 4] for r in sorted(out, key=lambda r: r.piece))
    assert back == ids and [r.n_tokens for r in sorted(out, key=lambda r: r.piece)] == [32, 32, 32, 4]


# ---- Matroska


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_payloads_come_back(data):
    payload = M.padded(data)
    file = M.mux(payload)
    media = M.parse(file)
    assert M.demux(file) == payload and len(payload) % 64 == 0 and payload
    assert [p.time_ns for p in media.packets] == [i * 8_000_000 for i in range(len(payload) // 64)]
    assert all(p.size == 64 and p.track == 1 and p.keyframe for p in media.packets)
    assert len(media.cues) == len(media.clusters) and all(0 < s - at <= 12 for (_, _, at), s in zip(media.cues, media.clusters, strict=True))
    assert f"cues={len(media.clusters)};" in M.feature(file, media)
    astray = media._replace(cues=[(t, k, at + 1) for t, k, at in media.cues] + [(0, 1, len(file))])
    assert "cues=0;" in M.feature(file, astray)
    assert media.tracks[1] == {"codec": "A_PCM/INT/LIT", "type": 2, "frame_ns": 8_000_000, "rate": 8000.0, "channels": 1, "bits": 8}


def test_all_lacings_are_written():
    lacings = Counter(p.lacing for p in M.parse(M.mux(bytes(64 * 200))).packets)
    assert set(lacings) == set(M.LACING) and lacings["none"] == 1


@pytest.mark.parametrize("sizes", [[5, 300, 2, 700, 1], [1, 1], [255, 510, 0, 3], [9000, 3, 9000, 1, 12]])
@pytest.mark.parametrize("lacing", [1, 3])
def test_laces_of_unlike_frames(sizes, lacing):
    rng = random.Random(1)
    frames = [rng.randbytes(n) for n in sizes]
    body = M._laced(frames, lacing)
    got, at = M._frame_sizes(body, 0, len(body), lacing)
    out = []
    for n in got:
        out.append(body[at : at + n])
        at += n
    assert out == frames


def test_groups_unknown_sizes_and_several_tracks():
    e, n = M._element, M._number
    block = lambda track, time, flags, data: bytes([0x80 | track]) + time.to_bytes(2, "big", signed=True) + bytes([flags]) + data
    cluster = n(M.CLUSTER_TIMESTAMP, 100) + e(M.BLOCK_GROUP, e(M.BLOCK, block(2, -5, 0, b"abc")) + n(M.BLOCK_DURATION, 7)) + e(M.BLOCK_GROUP, e(M.BLOCK, block(1, 3, 0, b"de")) + e(M.REFERENCE_BLOCK, b"\xff"))
    endless = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    tracks = e(M.TRACKS, b"".join(e(M.TRACK_ENTRY, n(M.TRACK_NUMBER, t) + n(M.TRACK_TYPE, t) + e(M.CODEC_ID, b"X")) for t in (1, 2)))
    body = e(M.INFO, n(M.TIMESTAMP_SCALE, 1000)) + tracks + endless + e(M.CLUSTER, n(M.CLUSTER_TIMESTAMP, 200) + e(M.SIMPLE_BLOCK, block(1, 0, 0x84, bytes([1]) + b"wxyz")))
    file = e(M.EBML, e(M.DOC_TYPE, b"matroska")) + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    media = M.parse(file)
    assert [(p.track, p.time_ns, file[p.start : p.start + p.size], p.keyframe, p.cluster, p.lacing) for p in media.packets] == [
        (2, 95_000, b"abc", True, 0, "none"),
        (1, 103_000, b"de", False, 0, "none"),
        (1, 200_000, b"wx", True, 1, "fixed"),
        (1, 200_000, b"yz", True, 1, "fixed"),
    ]
    assert M.demux(file, 2) == b"abc"


def test_packet_table(spark):
    file = M.mux(bytes(range(64)) * 20)
    rows = [(1, bytearray(file)), (2, bytearray(b"not media")), (3, None), (4, bytearray()), (5, bytearray(file[:-40]))]
    got = M.packet_table(spark.createDataFrame(rows, "id long, content binary").withColumn("track", F.lit("clash"))).collect()
    assert [(r.start, r["size"]) for r in got if r.id == 1] == [(p.start, p.size) for p in M.parse(file).packets]
    assert {r.id for r in got if r.error} == {2, 3, 4, 5} and all(r.track is None for r in got if r.error)
    assert M.packet_table(spark.createDataFrame([], "id long, content binary")).count() == 0


def test_stored_texts(spark):
    got = M.stored_texts(spark.createDataFrame(ODD, SCHEMA).withColumn("feature", F.lit("clash"))).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    text = {i: (t or "").encode() for i, t in ODD}
    for r in got:
        payload = text[r.doc_id] + bytes((-len(text[r.doc_id]) % 64) if text[r.doc_id] else 64)
        file = M.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(text[r.doc_id]), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert len({r.feature for r in got if r.doc_id == 4}) == 1
    assert M.stored_texts(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- pipeline and registry


def test_pipeline_stages_on_what_is_before_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.written(stage(spark, docs, SF), "test")
        rows = docs.collect()
        if name == "bpe":
            assert Counter(r.doc_id for r in rows) == Counter(taken)
            assert all(r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest() for r in rows)
            break
        assert docs.columns == names
        after = {r.doc_id: r.text for r in rows}
        if name == "toxicity":
            assert 0.5 * len(before) < len(after) <= len(before) and all(before[i] == t for i, t in after.items())
        elif name == "line_dedup":
            assert after.keys() == before.keys() and all(len(after[i]) <= len(before[i]) for i in after) and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in ((i, re.findall("[^\x20\x09-\x0d]+", t.lower())) for i, t in before.items()) if w}
            for i in before.keys() - after.keys():
                assert any(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in sets.items() if j != i)
            kept = [sets[i] for i in after if i in sets]
            assert not any(5 * len(a & b) >= 4 * len(a | b) for n, a in enumerate(kept) for b in kept[:n])
        else:
            taken = [r.doc_id for r in rows]
            assert max(Counter(taken).values()) <= 3 and all(before[i] == t for i, t in after.items())
        before = after


def test_stages_on_odd_documents(spark):
    clash = {c: F.lit("clash") for c in ("_row", "_gone", "_text", "_key", "_n", "size", "weight", "target", "h", "label")}
    rows = [(1, None, None, None, None), (None, "a b c d e f g", "en", "s", 13), (2, "", "en", None, 0), (3, "a b c d e f g\n", None, "s", 14), (3, "a b c d e f g\n", None, "s", 14), (4, "x" * 70_000, "de", "t", 70_000), (5, "A, B c d e F g", "en", "t", 14), (6, "idle words", "en", "t", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = storage.written(stage(spark, docs, SF), "test"), stage(spark, empty, SF)
        got = docs.collect()
        assert empty.count() == 0 and (name == "bpe" or set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars", *clash})
        if name == "line_dedup":
            assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "a b c d e f g"), (1, ""), (2, ""), (3, "a b c d e f g\n"), (3, "a b c d e f g\n"), (4, "x" * 70_000), (5, ""), (6, "idle words")]
            assert all(r.target == "clash" and r._gone == "clash" for r in got)
        if name == "near_dedup":
            assert Counter(r.doc_id for r in got) == Counter([None, 1, 2, 3, 3, 4, 5, 6])
        if name == "mixing":
            assert all(r.text and r._n == "clash" for r in got)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def test_registry():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_embedding_query_and_oracle_names(spark):
    got = __spark_entry__.queries()["op2_mixing"](spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "first_position"]


def test_shared_folder_is_the_sessions(spark):
    class Set:
        conf = {"spark.checkpoint.dir": "hdfs://name/folder/"}

    assert storage.shared_dir(Set) == "hdfs://name/folder"
    table = storage.written(spark.range(3).toDF("x"), "t")
    assert table.count() == 3 and table._path.startswith(storage.shared_dir(spark))
    storage.remove(table)
    assert not os.path.exists(table._path.removeprefix("file://"))
