from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuesift.llm import bpe, lines, mixing, quality, suffix_tree, toxicity
from cuesift.llm.packed import pack, unpack

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\n "), (None, "a null id"), (4, "x" * 150_000), (4, "x" * 150_000), (5, "ünï çødé 中文 \x00 end"), (6, "word " * 20_000)]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "n", "token", "label", "size", "held_out")})


def test_packed_integers():
    rng = np.random.default_rng(1)
    for values in ([], [0], [127, 128, 16383, 16384, 2**40], rng.integers(0, 2**21, 1000), rng.integers(0, 200, 1000)):
        assert unpack(pack(np.array(values, np.int64))).tolist() == list(values)


# ---- toxicity and quality


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    clean = [f"word{i}" for i in range(150)]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["Scoundrel!", "blackguard", "SCOUNDREL"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_learns_and_holds_out(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_toxicity_hits_are_the_sets_of_ngrams():
    column = pa.array(["abcd ABCD", "xy", "", "abcdé"], pa.large_string())
    from cuesift.llm.words import text_bytes

    hits = toxicity._hits(*text_bytes(column), None)
    expect = [len({t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}) for t in (x.lower().encode() for x in column.to_pylist())]
    assert np.bincount(hits >> toxicity.BITS, minlength=4).tolist() == expect


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_classifiers_on_odd_input(spark, run):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1), (9, None, None)], "doc_id long, toxic int, quality int")
    docs = odd(spark).select("doc_id", "text", "score").unionByName(spark.createDataFrame([(7, "bad words here", "z"), (8, "good words here", "z")], "doc_id long, text string, score string"))
    got = run(docs, labels).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert run(docs.where("false"), labels).count() == 0
    assert len({r.score for r in run(docs, labels.where("false")).collect()}) == 1


def test_sample_is_bounded_and_leaves_a_fold_out(spark):
    from cuesift.llm.labelled import sample

    docs = spark.createDataFrame([(i, f"{i}") for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert len(sample(docs, labels, "toxic", 50)) == 50
    got = sample(docs, labels, "toxic")
    assert sorted(int(t) for t, _ in got) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sum(len(t) for t, _ in sample(docs, labels, "toxic", max_bytes=20)) <= 20
    repeated = spark.createDataFrame([(0, "same")] * 5_000 + [(0, "longer text")], SCHEMA)
    assert sample(repeated, labels.where("doc_id = 0"), "toxic", 10, 100) == [("same", 0)]
    # a text beyond the bound is passed over, wherever it comes
    long = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.repeat(F.lit("x"), 5_000)).otherwise(F.lit("short")))
    got = sample(long, labels, "toxic", 200, 1_000)
    assert len(got) == sum(i % 10 > 0 and zlib.crc32(str(i).encode()) % 4 != 2 for i in range(200))
    # labels without documents take no place
    many = labels.select((F.col("doc_id") + 1_000).alias("doc_id"), "toxic").unionByName(labels)
    assert len(sample(docs, many, "toxic", 150)) == len(sample(docs, labels, "toxic", 150))


def test_quality_votes_are_those_of_all_cosines(spark):
    rows = labelled(120, 5)
    examples = [(t, y) for _, t, y in rows[:80]]
    space = quality.fit(examples, rank=12)
    texts = [t for _, t, _ in rows[80:]] + ["", "solo"]
    got = quality.vote(pa.array(texts, pa.large_string()), space, 7, 4)
    for t, s in zip(texts, got, strict=True):
        data = np.frombuffer(t.encode(), np.uint8)
        v = quality._unit(quality._weighed(quality._terms(data, np.array([0, len(data)])), space.idf) @ space.axes)[0]
        cosine = space.vectors @ v
        near = np.argsort(-cosine, kind="stable")[:7]
        w = np.maximum(cosine[near].astype(float), 1e-3) ** 4
        assert s == pytest.approx((w * space.labels[near]).sum() / w.sum(), abs=1e-4)


def test_quality_tells_layouts_apart(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.randint(20, 80))]
        kind = i % 4
        rows.append((i, " ".join(w) if kind else " ".join(rng.choice([f"{x}###", f"{x.upper()}!!", f"{x} {x} {x}"]) for x in w), int(kind > 0)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], SCHEMA), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality.quality(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i] == y for i, _, y in held]) > 0.95


# ---- lines

SIGNS = re.compile(r"[\x00-/:-@\[-`{-\x7f]+")


def line_parts(text):
    return re.findall(r"[^\n]+\n?|\n", text or "")


def brute_lines(rows, percent=80):
    """All pairs of distinct forms by edit distance in characters: (links, the places of each form)."""
    places = defaultdict(list)
    for doc, text in rows:
        for n, part in enumerate(line_parts(text)):
            if form := SIGNS.sub(" ", part.lower()).strip(" "):
                places[form].append((doc, n))
    # DuckDB compares bytes: every other character gets a byte that no form has
    strange = sorted({x for f in places for x in f if ord(x) > 127})
    spare = [chr(x) for x in (*range(1, 32), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128))]
    assert len(strange) <= len(spare)
    table = str.maketrans(dict(zip(strange, spare, strict=False)))
    forms = list(places)
    # no distance is below that of the bags of characters, which leaves out most pairs without loss
    letters = {x: k for k, x in enumerate(sorted({x for f in forms for x in f}))}
    bag, n = np.zeros((len(forms), len(letters)), np.int32), np.array([len(f) for f in forms])
    for k, f in enumerate(forms):
        np.add.at(bag[k], [letters[x] for x in f], 1)
    first, second = [], []
    for k in range(len(forms) - 1):
        gap = bag[k + 1 :] - bag[k]
        least = np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1))
        near = np.flatnonzero(least * 100 <= np.maximum(n[k + 1 :], n[k]) * (100 - percent))
        first.append(np.full(len(near), k))
        second.append(near + k + 1)
    c = duckdb.connect()
    c.register("f", pa.table({"i": np.arange(len(forms)), "t": [x.translate(table) for x in forms], "n": n}))
    c.register("p", pa.table({"a": np.concatenate(first), "b": np.concatenate(second)}))
    found = c.sql(f"""SELECT x.i, y.i FROM p JOIN f x ON p.a = x.i JOIN f y ON p.b = y.i
                      WHERE levenshtein(x.t, y.t) * 100 <= greatest(x.n, y.n) * {100 - percent}""").fetchall()
    return [(forms[i], forms[j]) for i, j in found], places


@pytest.fixture
def few_jobs(monkeypatch):
    """Small tables need neither slices nor the driver's collections."""
    monkeypatch.setattr(lines, "SLICES", 1)
    monkeypatch.setattr(lines, "ROUNDS", 1)
    monkeypatch.setattr(lines, "drop_shuffles", lambda spark: None)


def check_groups(spark, rows, most_missed):
    """Groups only join what links join, and few links are missed; keepers are the first places."""
    got = {(r.doc_id, r.line_no): ((r.keeper_doc_id, r.keeper_line_no), r.kept) for r in lines.like_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    links, places = brute_lines(rows)
    assert set(got) == {x for at in places.values() for x in at}
    parent = {f: f for f in places}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    members = defaultdict(set)
    for f, at in places.items():
        keeper = {got[x][0] for x in at}
        assert len(keeper) == 1  # equal lines are in one group
        members[keeper.pop()].add(f)
    for keeper, forms in members.items():
        assert len({root(f) for f in forms}) == 1 and keeper == min(x for f in forms for x in places[f])
    assert all(kept == (x == keeper) for x, (keeper, kept) in got.items())
    long = [(a, b) for a, b in links if min(len(a), len(b)) >= lines.MIN_CHARS]
    assert sum(got[places[a][0]][0] != got[places[b][0]][0] for a, b in long) <= most_missed * len(long)
    return len(long)


def line_corpus():
    rng = random.Random(7)
    vocabulary = [f"term{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 60, 80]))] for _ in range(60)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 15])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            line = " ".join(w)
            out.append(rng.choice([line, line.upper() + "!", "- " + line.replace(" ", ", ")]))
        rows.append((i * 2, "\n".join(out) + rng.choice(["", "\n", "\n\n"])))
    return rows


def test_line_groups_against_all_pairs(spark, few_jobs):
    # its words share a stem, so lines with a third of their words replaced link too, and some of those are missed
    assert check_groups(spark, line_corpus(), 0.2) > 100


def test_supplied_lines_against_all_pairs(spark, few_jobs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert check_groups(spark, [(r.doc_id, r.text) for r in docs], 0.1) > 10


def test_dedup_lines_keeps_texts_but_for_dropped_lines(spark, few_jobs):
    rows = line_corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text")).withColumn("h", F.lit("clash"))
    kept = {(r.doc_id, r.line_no): r.kept for r in lines.like_lines(df).collect()}
    assert not all(kept.values())
    out = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    for doc, text in rows:
        left = "".join(p for n, p in enumerate(line_parts(text)) if kept.get((doc, n), True))
        assert out[doc].text == left and out[doc].n_chars == len(left) and out[doc].h == "clash"


def test_lines_run_without_python(spark):
    """No plan of the whole operator, written tables included, has a Python node."""
    plans = []
    original = lines.written

    def spied(df, name, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, name, *by)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lines, "written", spied)
        patch.setattr("cuesift.llm.components.written", spied)
        out = lines.like_lines(spark.createDataFrame(line_corpus(), SCHEMA))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


def test_lines_of_odd_documents(spark, few_jobs):
    assert {r.kept for r in lines.like_lines(odd(spark)).where("doc_id = 4 or doc_id = 6").collect()} <= {True}
    kept = lines.dedup_lines(odd(spark)).orderBy("doc_id").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == sorted((str(i), t) for i, t in ODD if t)
    assert lines.like_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    big = "\n".join(["alpha beta gamma delta epsilon zeta"] * 3 + ["x y"])
    got = lines.dedup_lines(spark.createDataFrame([(1, big), (2, "Alpha, beta gamma; DELTA epsilon zeta.")], SCHEMA)).collect()
    assert {r.doc_id: r.text for r in got} == {1: "alpha beta gamma delta epsilon zeta\nx y", 2: ""}


# ---- mixing


def mix_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    c = duckdb.connect()
    ids, texts, sources = zip(*rows, strict=True)
    c.register("documents", pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "source": pa.array(sources, pa.string())}))
    return docs, [tuple(r) for r in c.sql(mixing.TAKEN_SQL).fetchall()]


def key(rows):
    return sorted((tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


def test_mixing_matches_sql_and_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), rng.choices(["a", "b", "c", "é", None], [60, 5, 1, 20, 10])[0]) for i in range(600)]
    docs, expect = mix_tables(spark, rows)
    got = [tuple(r) for r in mixing.taken(docs.withColumn("size", F.lit("clash"))).collect()]
    assert key(got) == key(expect)
    source = {i: s for i, _, s in rows}
    total, aim, own = Counter(), {}, {}
    for doc, size, source_size, target, taken, _ in got:
        assert 0 <= taken <= 3 * size and taken % max(size, 1) == 0
        total[source[doc]] += taken
        aim[source[doc]], own[source[doc]] = target, source_size
    assert all(abs(total[s] - aim[s]) <= 45 for s in aim) and all(aim[s] <= 3 * own[s] for s in aim)
    assert sum(aim.values()) == pytest.approx(sum(own.values()))


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 30), ("d", 2), ("e", 400), (None, 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", "e", None]
    weight, cap = {s: i % 3 + 1 for i, s in enumerate(order)}, {s: 3 * n for s, n in sizes}
    aim, open_, rest = {}, set(order), 1442.0
    while True:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            aim |= share
            break
        for s in over:
            aim[s] = cap[s]
        open_ -= over
        rest = 1442.0 - sum(aim.values())
    assert got == pytest.approx(aim)


def test_curriculum_orders_passes_by_inverted_demand(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.curriculum(docs, F.when(F.col("source") == "a", 3.0).otherwise(0.0), F.when(F.col("source") == "a", 1.0).otherwise(2.0)).collect()
    position = [r.position for r in out]
    assert position == sorted(position) and 0 <= position[0] and position[-1] <= 1
    again = mixing.curriculum(docs, F.when(F.col("source") == "a", 3.0).otherwise(0.0), F.when(F.col("source") == "a", 1.0).otherwise(2.0)).collect()
    assert [(r.doc_id, r.position) for r in out] == [(r.doc_id, r.position) for r in again]
    # tilts -0.5 and 1 have the mean 0.5 by target; less that they are -1 and 0.5
    for source, slope in (("a", -1.0), ("b", 0.5)):
        t = np.array([r.position for r in out if r.source == source])
        for at in (0.25, 0.5, 0.75):  # the share of a source's words by a time is its schedule's integral
            assert (t <= at).mean() == pytest.approx(at + slope * (at * at - at), abs=0.02)
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    assert Counter(r.doc_id for r in out) == {i: n // 10 for i, n in taken.items() if n}


def test_shares_follow_their_schedules(spark):
    """Positions are training progress, and each source's share at any time is the stated straight line."""
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.curriculum(docs).collect()
    part = Counter((min(4, int(r.position * 5)), r.source) for r in out)
    aim = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, 10_000) for s in "abc"], "source string, source_size long")).collect()}
    share = {s: v / sum(aim.values()) for s, v in aim.items()}
    mean = sum(share[s] * t for s, t in (("a", 0.5), ("b", 0.0), ("c", -0.5)))
    for fifth in range(5):
        n = sum(part[fifth, s] for s in "abc")
        assert n == pytest.approx(len(out) / 5, rel=0.02)
        for s, tilt in (("a", 0.5), ("b", 0.0), ("c", -0.5)):
            assert part[fifth, s] / n == pytest.approx(share[s] * (1 + (tilt - mean) * (2 * (fifth + 0.5) / 5 - 1)), abs=0.01)


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, f"a b c {i}", "x") for i in range(50)] + [(7, "same text here", "x")] * 50 + [(7, "other", "y")] * 3 + [(None, None, None)] * 3
    docs, expect = mix_tables(spark, rows)
    got = mixing.taken(docs.withColumns({"taken": F.lit("clash"), "position": F.lit(1), "_row": F.lit(2)})).collect()
    assert key([tuple(r) for r in got]) == key(expect) and len(got) == len(rows)


def test_mixing_odd_documents(spark):
    docs, expect = mix_tables(spark, [(i, t, s) for (i, t), s in zip(ODD, ["a", None, "b", "a", "c", "c", None, "a"], strict=True)])
    assert key([tuple(r) for r in mixing.taken(docs).collect()]) == key(expect)
    assert mixing.taken(docs.where("false")).count() == 0 and mixing.curriculum(docs.where("false")).count() == 0


# ---- byte-level BPE

public_tokenizers = pytest.importorskip("public_tokenizers")
RAW = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def tiktoken_rows(rows):
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(RAW), special_tokens={})
    out = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [1, 50, 400_000])
def test_bpe_is_what_tiktoken_gives(spark, chunk):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD + [(9, "It's  2024\n\n\n  x's'll <|endoftext|>"), (10, "   a"), (11, "👍🏽 é")]
    got = [tuple(r) for r in bpe.round_trip(spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.lit("clash")), RAW, public_tokenizers.PATTERN, chunk).collect()]
    assert sorted(got, key=str) == sorted(tiktoken_rows(rows), key=str)


def test_bpe_chunks_are_made_once(spark):
    plan = bpe.round_trip(spark.createDataFrame(ODD, SCHEMA), RAW, public_tokenizers.PATTERN)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), RAW, public_tokenizers.PATTERN).count() == 0


def test_encode_gives_ids_that_decode_to_the_text(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = bpe.encode(docs, RAW, public_tokenizers.PATTERN).withColumn("row", F.lit(0))
    back = sorted(((r.doc_id, bytes(r.bytes)) for r in bpe.decode(got, RAW).collect()), key=str)
    assert back == sorted(((i, (t or "").encode()) for i, t in ODD), key=str)


def test_decode(spark):
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(RAW), special_tokens={})
    rows = [(1, encoding.encode_ordinary("héllo wörld")), (2, []), (3, None)]
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), RAW).collect()}
    assert got == {1: "héllo wörld".encode(), 2: b"", 3: b""}


def test_merges_are_those_of_tiktoken():
    import tiktoken

    ranks = bpe._ranks(RAW)
    single = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    rng = random.Random(1)
    for n in (1, 2, 5, 20, 63, 64, 65, 66, 200, 3_000):
        for letters in ("a", "ab", "etaoin", "aé中x", " ", "-=", "\n\t"):
            for _ in range(5):
                word = "".join(rng.choice(letters) for _ in range(n)).encode()
                assert bpe.merged(word, ranks) == single(word)
                if word not in ranks:
                    assert bpe._merged_long(word, ranks) == single(word)


def test_long_texts_in_runs_are_as_whole(monkeypatch):
    """Words, shingles, signatures, n-grams and terms of one long text don't depend on where it is cut."""
    from cuesift.llm import near_dup, words

    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "The ", "é ", "foo\n", "zzz9 ", "x" * 300 + " ", "  "]) for _ in range(3_000)) + "y" * 5_000
    data, offsets = words.text_bytes(pa.array([text], pa.large_string()))
    elements = np.unique(np.random.default_rng(1).integers(0, 2**63, 5_000).astype(np.uint64))

    def all_of():
        return [
            words.word_hashes(data, offsets)[0], near_dup._joined(data, offsets, 4)[0], near_dup.super_minhash(elements, np.zeros(len(elements), np.int64), 1, 128),
            toxicity._hits(data, offsets, None), quality._terms(data, offsets),
        ]

    whole = all_of()
    for module in (words, near_dup, toxicity, quality):
        monkeypatch.setattr(module, "PIECE", 1_000)
    assert words.is_long(data, offsets)
    for a, b in zip(whole, all_of(), strict=True):
        np.testing.assert_allclose(a, b) if a.dtype.kind == "f" else np.testing.assert_array_equal(a, b)


# ---- suffix tree


def tokens_of(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low)), None]


def brute_tree(rows, depth=suffix_tree.DEPTH, per_depth=suffix_tree.NODES):
    """Scores by dictionaries of strings, from the definitions."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    learn = [tokens_of(t) for i, t in rows if not held(i)]
    c1 = Counter(w for x in learn for w in x)
    n, v, singles = sum(c1.values()), len(c1), sum(c == 1 for c in c1.values())
    least = max(suffix_tree.LEAST, n ** (2 / 3) / per_depth)
    tables = [{(w,): c for w, c in c1.items() if c >= least}]  # strings of 1, 2, ... words
    for length in range(2, depth + 2):
        c = Counter(tuple(x[i : i + length]) for x in learn for i in range(len(x) - length + 1))
        tables.append({k: m for k, m in c.items() if m >= least and k[:-1] in tables[-1] and k[1:] in tables[-1]})
    unknown = (singles + 0.5) / (n + 1)
    root = lambda w: (1 - unknown) * c1[w] / n if c1[w] else unknown
    nodes = {}

    def add(context, total, listed, below):
        mass, under, m = sum(listed.values()) / total, sum(map(below, listed)), len(listed)
        gain = sum(c * math.log(c / total / below(w)) for w, c in listed.items())
        if mass < 1:
            gain += total * (1 - mass) * math.log((1 - mass) / max(1 - under, 1e-12))
        if 2 * gain > m + 3 * math.sqrt(2 * m) + 10:
            p = {w: (c - 0.5) / total for w, c in listed.items()}
            nodes[context] = (p, (1 - sum(p.values())) / max(1 - under, 1e-12))

    def prob(context, w):
        if not context:
            return root(w)
        if context not in nodes:
            return prob(context[1:], w)
        p, rest = nodes[context]
        return p[w] if w in p else rest * prob(context[1:], w)

    for length in range(1, depth + 1):
        by = defaultdict(dict)
        for k, c in tables[length].items():
            by[k[:-1]][k[-1]] = c
        for context, listed in by.items():
            if length == 1 or context[1:] in nodes:
                add(context, tables[length - 1][context], listed, lambda w, context=context: prob(context[1:], w))
    out = {}
    for i, t in rows:
        x = tokens_of(t)
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        score = 0.0
        for at, w in enumerate(x):
            context = tuple(x[max(0, at - depth) : at])
            while context and context not in nodes:
                context = context[1:]
            score += math.log10(prob(context, w))
        out[i] = (held(i), len(x), sum(c1[w] > 0 for w in x), n, base, score)
    return out, nodes


def test_tree_scores_are_those_of_dictionaries(spark):
    rng = random.Random(5)
    letters = "abcde"
    after = {(a, b, c): rng.choice(letters) for a in letters for b in letters for c in letters}  # three words tell the next
    rows = []
    for i in range(400):
        w = [rng.choice(letters) for _ in range(3)]
        for _ in range(rng.randint(0, 40)):
            free = rng.choice(["x", "Y", f"rare{rng.randrange(500)}", *letters])
            w.append(after.get(tuple(w[-3:]), free) if rng.random() < 0.7 else free)
        rows.append((i, " ".join(w)))
    expect, nodes = brute_tree(rows)
    assert {len(k) for k in nodes} == {1, 2, 3}
    got = {r.doc_id: tuple(r)[1:] for r in suffix_tree.suffix_tree_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, e in expect.items():
        assert got[i][:4] == e[:4] and got[i][4] == pytest.approx(e[4]) and got[i][5] == pytest.approx(e[5])
    unseen = [i for i in got if got[i][0]]
    assert sum(got[i][5] for i in unseen) > sum(got[i][4] for i in unseen)


def test_tree_grows_with_the_corpus(spark):
    """Ten times the tokens of one source gather more strings, not the same number."""
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(30_000)]
    sizes = []
    for n in (3_000, 30_000):
        rows = [(k, " ".join(words[k : k + 100])) for k in range(0, n, 100)]
        docs = spark.createDataFrame(rows, SCHEMA)
        grown = []
        with pytest.MonkeyPatch.context() as patch:
            original = suffix_tree.grow
            patch.setattr(suffix_tree, "grow", lambda *a, original=original, grown=grown: grown.append(original(*a)) or grown[0])
            suffix_tree.suffix_tree_scores(docs)
        sizes.append(sum(len(level.keys) for level in grown[0].levels))
    assert sizes[1] > 2 * sizes[0] > 0


def test_tree_on_odd_documents(spark):
    got = suffix_tree.suffix_tree_scores(odd(spark)).collect()
    expect, _ = brute_tree([r for r in ODD if r[0] != 4] + [(4, ODD[4][1]), (4, ODD[4][1])])
    assert len(got) == len(ODD)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expect[r.doc_id][:4]
        assert r.base_score == pytest.approx(expect[r.doc_id][4]) and r.score == pytest.approx(expect[r.doc_id][5])
    assert suffix_tree.suffix_tree_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = suffix_tree.suffix_tree_scores(spark.createDataFrame([(None, "a b")], SCHEMA)).first()
    assert alone.train_tokens == 0 and alone.base_score == 0.0 and alone.n_tokens == 3
