from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuesift.llm import periodic, tandem
from cuesift.llm.periodic import run_digests, screened, word_runs
from cuesift.llm.tandem import Least, Suffixes, block_starts, tandem_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t, least=0, exponent=2):
    """(start, end, period) by comparing everything with everything."""
    n, out = len(t), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and t[j] == t[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b, p) for (a, b), p in out.items())


def listed(runs):
    return sorted(zip(*(x.tolist() for x in runs), strict=True))


sequences = st.one_of(
    st.lists(st.integers(0, 2), max_size=50),
    st.lists(st.integers(0, 4), max_size=50),
    st.tuples(st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 8), st.lists(st.integers(0, 2), max_size=8)).map(lambda x: x[0] + x[1] * x[2] + x[3]),
)


@settings(max_examples=400, deadline=None)
@given(sequences, st.integers(2, 4))
def test_runs_are_those_of_all_places_and_periods(t, exponent):
    assert listed(tandem_runs(np.array(t, np.int64), exponent)) == brute(t, 0, exponent)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=80))
def test_suffixes_and_blocks(t):
    s = Suffixes(np.array(t, np.int64))
    assert s.sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(t)), np.arange(len(t))))
    wanted = [0 if i == j else next((k for k in range(len(t)) if max(i, j) + k >= len(t) or t[i + k] != t[j + k]), 0) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert s.common(a, b).tolist() == wanted
    at, starts = 0, []
    while at < len(t):
        starts.append(at)
        at += max(1, max((int(x) for x, i, j in zip(wanted, a.tolist(), b.tolist(), strict=True) if i == at and j < at), default=0))
    assert block_starts(s).tolist() == starts


def test_least_of_any_stretch():
    v = np.random.default_rng(1).integers(0, 1000, 300).astype(np.int32)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    a, b = a[a <= b], b[a <= b]
    assert Least(v)(a, b).tolist() == [int(v[i : j + 1].min()) for i, j in zip(a, b, strict=True)]


def test_located_a_part_at_a_time(monkeypatch):
    t = np.random.default_rng(2).integers(0, 2, 3000)
    wanted = listed(tandem_runs(t))
    monkeypatch.setattr(tandem, "AT_ONCE", 50)
    assert listed(tandem_runs(t)) == wanted


@settings(max_examples=150, deadline=None)
@given(st.lists(sequences, min_size=1, max_size=5), st.integers(2, 4), st.integers(0, 9))
def test_screen_holds_every_run(texts, exponent, least):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    a, b = screened(np.array(sum(texts, []), np.int64), bounds, least, exponent)
    assert (a[1:] >= b[:-1]).all()
    for t, off in zip(texts, bounds.tolist(), strict=False):
        for start, end, _ in brute(t, least, exponent):
            assert ((a <= off + start) & (off + end <= b)).any()


def planted(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    return w


def digest(i, text):
    w = planted(i, text)
    runs = [(a, b - a, p) for a, b, p in brute(w, 6, 4)]
    runs.sort(key=lambda x: (x[0], x[2]))
    gone = {j for a, n, p in runs for j in range(a + p, a + n)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("screen", [1 << 18, 40])
def test_query_is_brute_force_on_a_table(spark, monkeypatch, screen):
    monkeypatch.setattr(periodic, "SCREENED", screen)
    monkeypatch.setattr(periodic, "SEARCHED", screen)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = collected(run_digests(docs))
    assert got == sorted((digest(*r) for r in rows), key=repr) and any(r[1] for r in got)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a"), (4, "a " * 7), (4, "a " * 7), (5, "A a A a A a A a"), (6, "x\x0by\x0cx\ry\nx y\tx y z"), (7, "é b " * 9 + "end"),
        (8, "a b c " * 5 + "a b c d " * 5), (9, "q " * 5), (10, "\x1c a " * 12), (11, "w " * 6 + "v w " * 8), (53, "one two three four five six seven"),
    ] + [(i, "a b a c d e f g h i j k") for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "collapsed", "n_runs", "start", "b", "period")})
    assert collected(run_digests(df)) == sorted((digest(*r) for r in rows), key=repr)
    assert run_digests(df.limit(0)).collect() == []


def test_operator_returns_spans_and_text(spark):
    df = spark.createDataFrame([(1, "go on and on and on and on to it")], "doc_id long, text string")
    row = word_runs(df, 4, 2).collect()[0]
    assert row["n_words"] == 10 and [tuple(x) for x in row["runs"]] == [(1, 7, 2)] and row["collapsed"] == "go on and to it"
    with pytest.raises(ValueError):
        word_runs(df, 4, 1)


def test_long_text(spark):
    rng = np.random.default_rng(4)
    period = [f"w{x}" for x in rng.integers(0, 900, 20_011)]
    words = [f"u{x}" for x in rng.integers(0, 500, 50_000)] + period * 5 + ["end"] + ["x"] * 100_000
    row = word_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()[0]
    assert [tuple(x) for x in row["runs"]][-2:] == [(50_000, 5 * 20_011, 20_011), (150_056, 100_000, 1)]
    assert row["collapsed"].split(" ") == words[: 50_000 + 20_011] + ["end", "x"]
