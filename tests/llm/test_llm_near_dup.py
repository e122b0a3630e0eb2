from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuesift.llm import near_dup
from cuesift.llm.components import bucket_groups, connected_components
from cuesift.llm.near_dup import near_duplicates, super_minhash
from cuesift.llm.vectors import embedding_groups
from cuesift.llm.words import mix, shingle_hashes, text_bytes, word_hashes

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = list(sets)
    link = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, link).items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x0b\x1c ", max_size=30), min_size=1, max_size=6))
def test_word_hashes_part_and_fold_as_the_pattern_does(texts):
    import pyarrow as pa

    h, bounds = word_hashes(*text_bytes(pa.array(texts)))
    flat = [w for t in texts for w in words(t)]
    assert np.diff(bounds).tolist() == [len(words(t)) for t in texts]
    by_word, by_hash = dict(zip(flat, h.tolist(), strict=True)), dict(zip(h.tolist(), flat, strict=True))
    assert [by_word[w] for w in flat] == h.tolist() and [by_hash[x] for x in h.tolist()] == flat


def test_long_words_and_shingles():
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(500)] + ["ab" * 40, "ba" * 40]
    h, _ = word_hashes(*text_bytes(pa.array(texts)))
    assert len(set(h.tolist())) == len(set(texts))
    h, bounds = shingle_hashes(*word_hashes(*text_bytes(pa.array(["a b c", "a b", "b a", "", "a b c d", "x a b c"]))), 3)
    parts = [h[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(p) for p in parts] == [1, 1, 1, 0, 2, 2]
    assert parts[0][0] == parts[4][0] == parts[5][1] and parts[1] != parts[2]


def test_super_minhash_estimates_with_less_variance_than_independent_minima():
    rng = np.random.default_rng(1)
    m, errors, plain = 64, [], []
    for _ in range(150):
        both, one, two = (mix(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (40, 10, 10))
        sets = [np.concatenate([both, one]), np.concatenate([both, two])]
        sig = super_minhash(np.concatenate(sets), np.repeat([0, 1], 50), 2, m)
        errors.append((sig[0] == sig[1]).mean() - 40 / 60)
        mins = [np.array([mix(x + np.uint64(j)).min() for j in range(m)]) for x in sets]
        plain.append((mins[0] == mins[1]).mean() - 40 / 60)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.std(plain)


def test_super_minhash_components_are_minima_of_the_definition():
    elements = mix(np.arange(1, 8, dtype=np.uint64))
    m = 16
    best = [float("inf")] * m
    for e in elements:
        order = list(range(m))
        for rank in range(m):
            draw = int(mix(np.array([(int(e) + (rank + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            to = rank + (draw >> 32) % (m - rank)
            order[rank], order[to] = order[to], order[rank]
            best[order[rank]] = min(best[order[rank]], rank << 32 | draw & 0xFFFFFFFF)
    assert super_minhash(elements, np.zeros(7, int), 1, m)[0].tolist() == best


def corpus(seed=4, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = words(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 6)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 4, 8, 40, 90]))]
        rows.append((i * 3 + 1, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_those_of_all_pairs(spark, k):
    rows = corpus()
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), k).collect()}
    expect = brute(rows, k)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expect
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_supplied_documents_match_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 4).collect()} == brute(rows, 4)


def test_a_large_group_is_joined_across_blocks(spark, monkeypatch):
    """Copies that differ from each other by more than from what links them, with blocks of eight."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert got == brute(rows, 4)


def test_odd_documents(spark):
    rows = [(None, "a b c d e"), (None, None), (1, None), (2, ""), (3, " \t "), (4, "a b c d e"), (4, "a b c d e"), (7, "a b c d e"), (5, "one"), (6, "ONE"), (8, "z " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "kept": F.lit("x"), "component_id": F.lit("y"), "set_id": F.lit(0)})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 4).collect()), key=str)
    expect = [(None, 2, None, True), (None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (7, 2, 4, False), (5, 1, 5, True), (6, 1, 5, False), (8, 1, 8, True)]
    assert got == sorted(expect, key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 650)]
    got = {r.id: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expect = components({x for e in edges for x in e}, edges)
    alone = {a for a, b in edges if a == b}
    assert {i: c for i, c in expect.items() if i in got} == got and set(expect) - set(got) <= alone
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bucket_groups_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    value = {i: rng.random() for i in range(150)}
    members = [(rng.randrange(6), i) for i in range(150) for _ in range(2)]
    numbers = spark.createDataFrame(list(value.items()), "id long, x double")

    def verify(pairs):
        a, b = numbers.selectExpr("id a", "x p"), numbers.selectExpr("id b", "x q")
        return pairs.join(a, "a").join(b, "b").where("abs(p - q) < 0.004").select("a", "b")

    def rest(now):
        a, b = now.selectExpr("key", "id a", "group g"), now.selectExpr("key", "id b", "group h")
        return verify(a.join(b, "key").where("a < b and g != h").select("a", "b").distinct()).selectExpr("a u", "b v")

    table = spark.createDataFrame(members, "key long, id long")
    got = {r.id: r.label for r in bucket_groups(table, verify, rest).collect()}
    assert got == {r.id: r.label for r in bucket_groups(table, verify, rest, stars=1).collect()}
    buckets = defaultdict(set)
    for key, i in members:
        buckets[key].add(i)
    links = [(a, b) for m in buckets.values() for a in m for b in m if a < b and abs(value[a] - value[b]) < 0.004]
    expect = components(value, links)
    assert got == {i: c for i, c in expect.items() if i in got}
    assert all(i == c for i, c in expect.items() if i not in got)


def brute_vectors(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0}
    ids = list(good)
    link = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold]
    n = defaultdict(int)
    for a, b in link:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], c) for i, c in components([i for i, _ in rows], link).items()}, link


def test_embedding_groups_find_nearly_all_links_and_none_below(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (centre + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25, 0.32])).astype(np.float32).tolist()))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    expect, link = brute_vectors(rows)
    assert sum(n for n, _ in got.values()) >= 0.9 * 2 * len(link)
    assert all(got[i][0] <= expect[i][0] for i in got)
    assert sum(got[i] == expect[i] for i in got) >= 0.95 * len(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [0.0, 1.0])]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0])], "vec_id long, embedding array<float>").withColumns({"item": F.lit("x"), "label": F.lit(1), "kept": F.lit(0)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(df).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_vectors(rows)[0].items()}
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
