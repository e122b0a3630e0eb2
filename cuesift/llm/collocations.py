"""Phrases whose words come together more often than their parts would.

Tasks count words, pairs and triples in depth-limited tries, one for each shard of a bounded number of
words. A trie is written as sorted segments, one for each range of prefixes; the segments of a range are merged
by one task. In the merged trie the nodes above a phrase give its left parts; its right part, the phrase
without its first word, is the node its suffix link points to, found by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesift.llm.packed import pack, unpack
from cuesift.llm.storage import remove, written
from cuesift.llm.words import mix

LEAST, MOST_WORDS, TOP = 10, 3, 2000
#: Words of a shard, and bytes of its texts, after which its trie is written.
SHARD, SHARD_BYTES = 1 << 20, 32 << 20
#: Ranges of prefixes: one for so many bytes of text, between these bounds.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 8 << 20, 128, 1 << 16
#: Signs that end a piece; a blank or a tab ends a word.
_SIGNS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_SIGNS + b"\t" + bytes(range(65, 91)), b"\xff" * len(_SIGNS) + b" " + bytes(range(97, 123)))
_BREAK = b"\xff"

_PREFIX = "lang string, one string, two string, n bigint"
_NODES = "lang string, depth int, phrase string, head string, rest string, a bigint, l1 bigint, l2 bigint"


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _hash(words: list[bytes], seed: int) -> np.ndarray:
    return mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(seed << 32))


class Trie:
    """Counts of words, pairs and triples of words by language: a level for each length, nodes in byte order.

    ``lang`` and ``word`` name the first level's nodes, ``up`` a deeper node's parent in the level above.
    """

    def __init__(self, langs: list[bytes], words: list[bytes], lang: np.ndarray, token: np.ndarray):
        """``token``: numbers of ``words`` in order, -1 where a piece ends; ``lang``: the language of each."""
        order = sorted(range(len(words)), key=words.__getitem__)
        self.langs, self.words = langs, [words[i] for i in order]
        rank = np.empty(len(words) + 1, np.int64)
        rank[order] = np.arange(len(words))
        rank[-1] = -1
        w = rank[token]
        width = max(len(words), 1)
        here = np.flatnonzero(w >= 0)
        key, self.levels = lang[here] * width + w[here], []
        for depth in range(1, MOST_WORDS + 1):
            name, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            self.levels.append((name // width, name % width, count))
            if depth < MOST_WORDS:
                on = here + depth < len(w)
                on[on] = (w[here[on] + depth] >= 0) & (lang[here[on] + depth] == lang[here[on]])
                here = here[on]
                key = inverse[on] * width + w[here + depth]

    @property
    def tokens(self) -> int:
        return int(self.levels[0][2].sum())


_Shard = tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    """The texts of a task, about ``SHARD`` words at a time: languages, words, and each word's language and number, -1 where a piece ends."""
    langs, words, parts, who, size, held = _Ids(), _Ids(), [], [], 0, 0
    for batch in batches:
        for text, lang in zip(batch["text"].cast(pa.binary()), batch["lang"].cast(pa.binary()).to_pylist(), strict=True):
            text = text.as_py()
            if not text:
                continue
            found = text.translate(_FOLD).replace(_BREAK, b" \xff ").split(b" ")
            part = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
            parts += [part, np.array([words[_BREAK]])]
            who.append((langs[b"und" if lang is None else lang], len(part) + 1))
            size, held = size + len(part), held + len(text)
            if size >= SHARD or held >= SHARD_BYTES:
                shard = _shard(langs, words, parts, who)
                langs, words, parts, who, size, held = _Ids(), _Ids(), [], [], 0, 0
                yield shard
    if parts:
        yield _shard(langs, words, parts, who)


def _shard(langs: _Ids, words: _Ids, parts: list[np.ndarray], who: list[tuple[int, int]]) -> _Shard:
    token = np.concatenate(parts)
    lang = np.repeat(np.array([x for x, _ in who], np.int64), [n for _, n in who])
    if b"" in words:  # what stands between two blanks
        some = token != words[b""]
        token, lang = token[some], lang[some]
    token[token == words[_BREAK]] = -1
    return list(langs), list(words), lang, token  # no word that counts has the number of a mark


def _often(key: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur at least so often, and how often."""
    name, count = np.unique(key, return_counts=True)
    some = count >= share
    return name[some], count[some]


def _common(ranges: int):
    """Texts -> each shard's prefixes of one and two words that hold more of it than half a range's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, lang, token in _shards(batches):
            here = np.flatnonzero(token >= 0)
            share, width = len(here) / (2 * ranges), len(words)
            # only words that are common in all languages together can be so in one, or begin or end a common pair
            often = np.append(np.bincount(token[here], minlength=width) >= share, False)
            here = here[often[token[here]]]
            one, n1 = _often(lang[here] * width + token[here], share)
            here = here[here + 1 < len(token)]
            here = here[often[token[here + 1]] & (lang[here + 1] == lang[here])]
            two, n2 = _often((lang[here] * width + token[here]) * width + token[here + 1], share)
            text = lambda names, at: (names[i] for i in at.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None, *text(langs, one // width), *text(langs, two // width // width)], pa.binary()).cast(pa.string()),
                    pa.array([None, *text(words, one % width), *text(words, two // width % width)], pa.binary()).cast(pa.string()),
                    pa.array([None, *(None for _ in one), *text(words, two % width)], pa.binary()).cast(pa.string()),
                    pa.array([int((token >= 0).sum()), *n1.tolist(), *n2.tolist()], pa.int64()),
                ],
                names=["lang", "one", "two", "n"],
            )

    return run


class Ranges:
    """Which ranges hold a node: that of its first word, or, below a common prefix, of its next word too.

    ``common`` has the number of parts of each common prefix (lang, word) or (lang, word, word). All parts of a prefix hold its own count.
    """

    def __init__(self, count: int, common: dict[tuple[bytes, ...], int]):
        self.count, self.common = count, common

    def of(self, trie: Trie) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: ranges, nodes, and whether the range is the node's own, which reports it; by range and node."""
        n = np.uint64(self.count)
        (lang, one, _), (up2, two, _), (up3, three, _) = trie.levels
        word = _hash(trie.words, 1)
        name = _hash(trie.langs, 2)
        own1 = mix(name[lang] * np.uint64(31) + word[one])
        parts1, parts2 = np.zeros(len(one), np.uint64), np.zeros(len(two), np.uint64)
        known = {x: i for i, x in enumerate(trie.words)}
        place = {x: i for i, x in enumerate(trie.langs)}
        width = max(len(trie.words), 1)
        first, second = lang * width + one, up2 * width + two
        for key, parts in sorted(self.common.items(), key=lambda x: len(x[0])):
            if key[0] not in place or any(w not in known for w in key[1:]):
                continue
            i = int(np.searchsorted(first, at := place[key[0]] * width + known[key[1]]))
            if i == len(first) or first[i] != at:
                continue
            if len(key) == 2:
                parts1[i] = parts
            elif (j := int(np.searchsorted(second, at := i * width + known[key[2]]))) < len(second) and second[j] == at:
                parts2[j] = parts
        part = lambda own, parts, next_word: np.where(parts > 0, mix(own + np.uint64(1) + next_word % np.maximum(parts, np.uint64(1))), own)
        own2 = part(own1[up2], parts1[up2], word[two])
        own3 = part(own2[up3], parts2[up3], word[three])
        own = [(x % n).astype(np.int64) for x in (own1, own2, own3)]
        extra: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for level, hashes, parts in ((0, own1, parts1), (1, own2, parts2)):
            for i in np.flatnonzero(parts).tolist():
                at = (mix(hashes[i] + np.uint64(1) + np.arange(int(parts[i]), dtype=np.uint64)) % n).astype(np.int64)
                extra[level].append((at, np.full(len(at), i)))
                if level:
                    extra[0].append((at, np.full(len(at), up2[i])))
        # a node is also where its children are
        extra[0].append((own[1], up2))
        out = []
        for level, at in enumerate(own):
            size = len(at)
            if level == 2 or not size:  # each in one range
                node = np.argsort(at.astype(np.uint16) if self.count <= 1 << 16 else at, kind="stable")
                out.append((at[node], node, np.ones(size, bool)))
                continue
            key = np.sort(np.concatenate([at * size + np.arange(size), *(r * size + i for r, i in extra[level])]))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            where, node = key // size, key % size
            out.append((where, node, at[node] == where))
        return out


def _written_segment(trie: Trie, nodes: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Nodes (and whether they are reported here) of a range as bytes: names, then each level's parents, words and counts."""
    flag = np.zeros(len(trie.words), bool)
    for (_, word, _), (at, _) in zip(trie.levels, nodes, strict=True):
        flag[word[at]] = True
    used = np.flatnonzero(flag)
    number = np.empty(len(flag), np.int64)
    number[used] = np.arange(len(used))
    words = b"\n".join(map(trie.words.__getitem__, used.tolist()))
    langs = np.unique(trie.levels[0][0][nodes[0][0]])
    names = [trie.langs[i] for i in langs.tolist()]
    parts = [words, pack(np.array([len(x) for x in names])), b"".join(names)]
    above = langs
    for (up, word, count), (at, own) in zip(trie.levels, nodes, strict=True):
        parent = np.searchsorted(above, up[at])
        parts += [pack(np.diff(parent, prepend=0)), pack(number[word[at]]), pack(count[at] * 2 + own)]
        above = at
    return b"".join([pack(np.array([len(x) for x in parts])).ljust(64, b"\x80"), *parts])


def _read_segment(blob: bytes) -> tuple[list[bytes], list[bytes], list[tuple[np.ndarray, ...]]]:
    """Languages, words, and for each level parents, words, counts and whether they are reported here."""
    sizes = unpack(blob[:64].rstrip(b"\x80"))[: 3 + 3 * MOST_WORDS]
    ends = 64 + np.cumsum(sizes)
    parts = [blob[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    end = np.cumsum(unpack(parts[1]))
    langs = [parts[2][a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
    levels = []
    for d in range(3, len(parts), 3):
        up, word, count = (unpack(x) for x in parts[d : d + 3])
        levels.append((np.cumsum(up), word, count >> 1, (count & 1).astype(bool)))
    return langs, parts[0].split(b"\n") if parts[0] else [], levels


def _segments(ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            trie = Trie(*shard)
            if not trie.tokens:
                continue
            held = ranges.of(trie)
            where = np.unique(held[0][0])
            cut = [(np.searchsorted(at, where), np.searchsorted(at, where, "right")) for at, _, _ in held]
            blobs = [_written_segment(trie, [(node[a[i] : b[i]], own[a[i] : b[i]]) for (_, node, own), (a, b) in zip(held, cut, strict=True)]) for i in range(len(where))]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "segment"])

    return run


def _summed(key: np.ndarray, count: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted runs of keys, one after the other, merged: keys, sums, whether any is its own, and where each key went."""
    if not len(key):
        return key, count, own, key
    order = np.argsort(key, kind="stable")  # merges the runs that it meets
    key = key[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(head)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(head) - 1
    return key[first], np.add.reduceat(count[order], first), np.logical_or.reduceat(own[order], first), place


def _merged(least: int):
    """The segments of a range -> the nodes that it reports with at least ``least`` occurrences, and each language's words (depth 0)."""

    def run(table: pa.Table) -> pa.Table:
        segments = [_read_segment(x.as_py()) for x in table["segment"]]
        langs = sorted({x for s in segments for x in s[0]})
        words = sorted({x for s in segments for x in s[1]})
        number, name = {x: i for i, x in enumerate(words)}, {x: i for i, x in enumerate(langs)}
        rank = [np.fromiter(map(number.__getitem__, s[1]), np.int64, len(s[1])) for s in segments]
        width = max(len(words), 1)
        ups = [np.fromiter(map(name.__getitem__, s[0]), np.int64, len(s[0])) for s in segments]
        levels = []
        for d in range(MOST_WORDS):
            key = np.concatenate([u[s[2][d][0]] * width + r[s[2][d][1]] for s, r, u in zip(segments, rank, ups, strict=True)])
            key, count, own, place = _summed(key, *(np.concatenate([s[2][d][x] for s in segments]) for x in (2, 3)))
            levels.append((key // width, key % width, count, own))
            ups = np.split(place, np.cumsum([len(s[2][d][0]) for s in segments])[:-1])
        (lang, one, n1, own1), (up2, two, n2, own2), (up3, three, n3, _) = levels
        total = np.bincount(lang[own1], weights=n1[own1].astype(np.float64), minlength=len(langs)) if len(lang) else np.zeros(len(langs))
        a, b, c = np.flatnonzero(own1 & (n1 >= least)), np.flatnonzero(own2 & (n2 >= least)), np.flatnonzero(n3 >= least)
        top2, top3 = up2[b], up2[up3[c]]
        mid3 = up3[c]
        pair = lambda x, y: [words[i] + b" " + words[j] for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        single = [words[i] for i in one[a].tolist()]
        heads, rests = pair(one[top3], two[mid3]), pair(two[mid3], three[c])
        some = np.flatnonzero(total).tolist()
        none = lambda n: [None] * n
        text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
        long = lambda *x: pa.array([v for part in x for v in (part if isinstance(part, list) else part.tolist())], pa.int64())
        return pa.table(
            {
                "lang": text([langs[i] for i in [*some, *lang[a].tolist(), *lang[top2].tolist(), *lang[top3].tolist()]]),
                "depth": pa.array(np.repeat(np.arange(4), [len(some), len(a), len(b), len(c)]), pa.int32()),
                "phrase": text([*none(len(some)), *single, *pair(one[top2], two[b]), *(x + b" " + words[j] for x, j in zip(heads, three[c].tolist(), strict=True))]),
                "head": text([*none(len(some) + len(a)), *(words[i] for i in one[top2].tolist()), *heads]),
                "rest": text([*none(len(some) + len(a)), *(words[i] for i in two[b].tolist()), *rests]),
                "a": long([int(x) for x in total[some]], n1[a], n2[b], n3[c]),
                "l1": long(none(len(some) + len(a)), n1[top2], n1[top3]),
                "l2": long(none(len(some) + len(a) + len(b)), n2[mid3]),
            }
        )

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Words (depth 1), pairs and triples within pieces that occur at least ``least`` times in a language, and languages (depth 0).

    lang, depth, phrase, head (without its last word), rest (without its first), a (occurrences; for depth 0 all words of the
    language), l1 and l2 (occurrences of its first word and of its first two). Removed by the caller.
    """
    src = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(max(size // RANGE_BYTES, LEAST_RANGES), MOST_RANGES))
    prefixes = written(src.mapInArrow(_common(ranges), _PREFIX).groupBy("lang", "one", "two").agg(F.sum("n").alias("n")), "prefixes")
    total = (prefixes.where("one is null").first() or {"n": 0})["n"]
    # at most 2 x ranges words and as many pairs hold so much
    rows = prefixes.where("one is not null").where(F.col("n") * 2 * ranges >= total).collect()
    common = {tuple(x.encode() for x in (r["lang"], r["one"], r["two"]) if x is not None): -(-r["n"] * 2 * ranges // total) for r in rows}
    segments = src.mapInArrow(_segments(Ranges(ranges, common)), "range bigint, segment binary")
    nodes = written(segments.groupBy("range").applyInArrow(_merged(least), _NODES), "nodes")
    remove(prefixes)
    return nodes


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = 50) -> DataFrame:
    """The ``top`` phrases of two and three words of each language, by how much oftener they occur than their parts allow.

    One row per language and rank: lang, rank (from 1), phrase, a (its occurrences), l and r (those of the parts of its
    lowest-scoring cut), n (words of the language), score = floor(1000000 a a / (l r)), exactly. Candidates
    occur at least ``least`` times; one whose words lie inside a longer candidate with at least
    ``cover`` percent of its occurrences is left out. Order: score, then a, both descending, then phrase in byte order.

    A-Z are lower-cased; the signs . , ; : ! ? and the bytes 10 to 13 end a piece, blanks and tabs a word. text and lang are
    read; other columns may have any names. A null text is empty, a null lang is ``und``. Repeated rows count as often as they stand there.
    An empty table, or one without candidates, gives no rows.
    """
    nodes = phrase_counts(docs, least)
    depth = lambda n: nodes.where(F.col("depth") == n)
    one = depth(1).select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r1"))
    pairs = written(depth(2).select("lang", "phrase", "rest", "a", "l1").join(one, ["lang", "rest"]), "pairs")
    link = pairs.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r2"), "r1")
    triples = depth(3).select("lang", "phrase", "head", "rest", "a", "l1", "l2").join(link, ["lang", "rest"])
    exact = lambda a, l, r: f"cast(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0))) as bigint)"  # noqa: E731, E741
    over = depth(3).select("lang", F.explode(F.array("head", "rest")).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    pairs_left = pairs.join(over, ["lang", "phrase"], "left").where(f"b is null or 100 * b < {int(cover)} * a")
    two = pairs_left.select("lang", "phrase", "a", F.col("l1").alias("l"), F.col("r1").alias("r"), F.expr(exact("a", "l1", "r1")).alias("score"))
    three = triples.withColumn("s1", F.expr(exact("a", "l1", "r2"))).withColumn("s2", F.expr(exact("a", "l2", "r1")))
    left = F.col("s1") <= F.col("s2")
    three = three.select("lang", "phrase", "a", F.when(left, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(left, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
    total = depth(0).groupBy("lang").agg(F.sum("a").alias("n"))
    out = written(best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    remove(nodes)
    remove(pairs)
    return out


#: The same rows by listing every word sequence.
COLLOCATIONS_SQL = """
with docs as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), pieces as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as piece from docs)
), grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase,
    array_to_string(w[i:i], ' ') as w1, array_to_string(w[i:i + k - 2], ' ') as head, array_to_string(w[i + 1:i + k - 1], ' ') as rest, array_to_string(w[i + k - 1:i + k - 1], ' ') as w3
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces), (values (1), (2), (3)) as v(k) where i + k - 1 <= len(w)
), f as (
  select lang, k, phrase, any_value(w1) as w1, any_value(head) as head, any_value(rest) as rest, any_value(w3) as w3, count(*)::hugeint as a from grams group by lang, k, phrase
), total as (
  select lang, sum(a) as n from f where k = 1 group by lang
), kept as (
  select c.* from f c where c.k > 1 and c.a >= 10 and not exists (
    select 1 from f o where o.k = 3 and c.k = 2 and o.a >= 10 and o.lang = c.lang and c.phrase in (o.head, o.rest) and 100 * o.a >= 50 * c.a)
), cuts as (
  select c.lang, c.phrase, c.a, 1 as k, l.a as l, r.a as r from kept c join f l on l.lang = c.lang and l.phrase = c.w1 and l.k = 1 join f r on r.lang = c.lang and r.phrase = c.rest and r.k = c.k - 1
  union all
  select c.lang, c.phrase, c.a, 2, l.a, r.a from kept c join f l on l.lang = c.lang and l.phrase = c.head and l.k = 2 join f r on r.lang = c.lang and r.phrase = c.w3 and r.k = 1 where c.k = 3
), scored as (
  select *, (1000000 * a * a) // (l * r) as score from cuts
), lowest as (
  select *, row_number() over (partition by lang, phrase order by score, k) as cut from scored
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest where cut = 1
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""
