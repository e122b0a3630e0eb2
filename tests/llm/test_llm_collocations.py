from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesift.llm import collocations as c
from cuesift.llm.collocations import COLLOCATIONS_SQL, Ranges, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least=10, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {x: n for x, n in f.items() if n >= least and len(x[1]) > 1}
    gone = {(lang, part) for (lang, w), n in often.items() if len(w) == 3 for part in (w[:2], w[1:]) if 100 * n >= 50 * f[lang, part]}
    out = []
    for lang in total:
        found = []
        for (g, w), a in often.items():
            if g == lang and (g, w) not in gone:
                s, _, left, right = min((10**6 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
                found.append((-s, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[x] for x in COLUMNS) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def random_rows(seed, n=300):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "b", "é", "É", "to", "go", "x1", "\x1c", "ß"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]
    return [("".join(words[min(9, int(w))] + ends[int(e)] for w, e in zip(rng.geometric(0.3, 60) - 1, rng.integers(0, 11, 60), strict=True)), [None, "en", "de", "und"][i % 4]) for i in range(n)]


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_phrases_are_those_of_all_sequences(spark, monkeypatch, shard):
    monkeypatch.setattr(c, "SHARD", shard)
    monkeypatch.setattr(c, "LEAST_RANGES", 40)  # most words and many pairs of so few are common
    rows = random_rows(1)
    wanted = brute(rows)
    assert got(collocations(table(spark, rows))) == wanted and len(wanted) > 100
    assert got(collocations(table(spark, rows), top=5)) == brute(rows, top=5)


def test_ranges_hold_prefixes_of_their_nodes():
    rng = np.random.default_rng(2)
    words = [b"w%d" % i for i in range(50)]
    trie = c.Trie([b"en", b"de"], words, rng.integers(0, 2, 5000), np.where(rng.random(5000) < 0.1, -1, np.minimum(49, rng.geometric(0.2, 5000))))
    common = {(b"en", b"w1"): 7, (b"de", b"w1"): 3, (b"en", b"w1", b"w2"): 5, (b"de", b"w3", b"w3"): 4, (b"xx", b"w1"): 2, (b"en", b"zz"): 2}
    held = Ranges(16, common).of(trie)
    for d in (1, 2):
        up = trie.levels[d][0]
        above = set(zip(held[d - 1][0].tolist(), held[d - 1][1].tolist(), strict=True))
        assert {(r, int(up[i])) for r, i in zip(held[d][0].tolist(), held[d][1].tolist(), strict=True)} <= above
    for (_, node, own), level in zip(held, trie.levels, strict=True):
        assert np.bincount(node[own], minlength=len(level[0])).tolist() == [1] * len(level[0])


def test_segments_read_as_written():
    rng = np.random.default_rng(3)
    trie = c.Trie([b"en", b"\n"], [b"x%d" % i for i in range(300)], rng.integers(0, 2, 3000), rng.integers(-1, 300, 3000))
    (r, node, own), *rest = held = Ranges(5, {}).of(trie)
    pick = [(n[at == 3], o[at == 3]) for at, n, o in held]
    langs, words, levels = c._read_segment(c._written_segment(trie, pick))
    for (up, word, count, mine), (at, o), level in zip(levels, pick, trie.levels, strict=True):
        assert [words[i] for i in word] == [trie.words[i] for i in level[1][at]] and count.tolist() == level[2][at].tolist() and mine.tolist() == o.tolist()
        assert len(up) == len(at)
    assert langs == [b"en", b"\n"]


def test_odd_rows(spark):
    rows = [(None, "en"), ("", "en"), (" \t ", None), (".,;:!?\n\x0b\x0c\r", "en"), ("Same words here. " * 15, "en"), ("Same words here. " * 15, "en"), ("same words " * 20, ""), ("x  y\tz " * 12, None), ("ÉA é! " * 11, "fr")]
    df = table(spark, rows).withColumns({x: F.lit(1) for x in ("a", "l", "r", "n", "score", "rank", "phrase", "range", "depth", "head", "rest")})
    assert got(collocations(df)) == brute(rows)
    assert got(collocations(df.limit(0))) == [] and got(collocations(table(spark, [("one two", "en")]))) == []


def test_long_text_and_common_words(spark):
    rng = np.random.default_rng(4)
    rows = [(" ".join("the" if x < 30 else f"w{x}" for x in rng.integers(0, 90, 60_000)), "en"), (" ".join(f"w{x}" for x in rng.integers(0, 40, 5_000)), "en"), ("the the " * 5000, "de")]
    assert got(collocations(table(spark, rows))) == brute(rows)


def test_query_equals_its_sql(spark):
    from cuesift.llm.queries import op13_collocations

    duckdb.sql("create or replace view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    wanted = sorted(duckdb.sql(f"select {', '.join(COLUMNS)} from ({COLLOCATIONS_SQL})").fetchall())
    assert got(op13_collocations(spark, "/root/testdata/sf0.001")) == wanted and wanted
