"""Language-model scoring with a probabilistic suffix tree over words.

After Ron, Singer and Tishby (1996): contexts of up to ``DEPTH`` words that are frequent in the training
documents are candidates; one is retained if its next-word distribution diverges from that of its
suffix by more than chance; distributions are smoothed by taking a discount from every seen next word and giving it
to the others as the suffix has them; a word is scored from the longest retained suffix of what
precedes it. The root knows every training word. All counts are over all training documents.

What counts as frequent follows the corpus: strings seen in N tokens at least N^(2/3) / ``NODES`` times (8
at least), so each depth gathers up to ``NODES`` x N^(1/3) of them: 50,000 at 3.6 million tokens, 640,000 at 7 billion,
10 million at 25 trillion. That is the bound of what goes to every task (16 bytes each); the root's
table grows with the vocabulary and is joined by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cuesift.llm.labelled import fold
from cuesift.llm.packed import pack, unpack
from cuesift.llm.storage import written
from cuesift.llm.words import pieces, word_hashes

#: Words of the longest context; strings of a depth for each cube root of the tokens; least count of any.
DEPTH, NODES, LEAST = 3, 330, 8
DISCOUNT = 0.5
#: The base model adds this to every count.
ADDED = 0.1
#: Tokens at which a chunk of documents is closed.
CHUNK_TOKENS = 1_500_000
_END = np.uint64(0x5851F42D4C957F2D)
_PLACE_BITS = 31


@dataclass(frozen=True)
class Level:
    """Nodes of one depth d. A node is a frequent string of d words, by its place among those.

    ``keys`` are the frequent strings of d + 1 words, sorted: node * number of words + next word. ``log`` is the log10
    probability of that next word at the node (nan: the node isn't retained), ``rest`` is by node the log10 share that a
    word not listed gets times its probability at the suffix (nan: not retained).
    """

    keys: np.ndarray
    log: np.ndarray
    rest: np.ndarray


@dataclass(frozen=True)
class Tree:
    """``words`` are the hashes of the frequent words, sorted; a word's number is its place among them."""

    words: np.ndarray
    levels: tuple[Level, ...]


def _find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value among sorted keys, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _chunks(id_type: pa.DataType):
    """doc_id, held_out, text -> one row per chunk: distinct tokens, training counts, packed places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = number = TaskContext.get().partitionId() << 12
        ids, held, counts, tokens, total = [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            count = np.concatenate(counts)
            values, place, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # small places for frequent tokens
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[place]
            learnt = np.bincount(place, np.repeat(~np.concatenate(held), count), minlength=len(order)).astype(np.int64)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
            columns = [pa.array([number], pa.int64()), one(sum(ids, []), id_type), one(np.concatenate(held), pa.bool_()), one(count, pa.int64()), pa.array([pack(place)], pa.binary()), one(values[order].view(np.int64), pa.int64()), one(learnt, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_ids", "held", "counts", "places", "tokens", "learnt"])

        for batch in batches:
            for start, end, data, offsets in pieces(batch["text"]):
                words, bounds = word_hashes(data, offsets)
                ids.append(batch["doc_id"].slice(start, end - start).to_pylist())
                held.append(batch["held_out"].slice(start, end - start).to_numpy(zero_copy_only=False).astype(bool))
                counts.append(np.diff(bounds) + 1)
                tokens.append(np.insert(words, bounds[1:], _END))
                total += len(tokens[-1])
                if total >= CHUNK_TOKENS:
                    yield closed()
                    if (number := number + 1) >= first + (1 << 12):
                        raise ValueError("a partition has more chunks than numbers; deal the input to more partitions")
                    ids, held, counts, tokens, total = [], [], [], [], 0
        if ids:
            yield closed()

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct tokens, each token's place among them, and each token's document."""
    counts = np.array(row["counts"], np.int64)
    return np.array(row["tokens"], np.int64).view(np.uint64), unpack(row["places"]), np.repeat(np.arange(len(counts)), counts)


def _places(words: np.ndarray, strings: list[np.ndarray], word: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
    """For each length from 1 on, the place of the frequent string that ends at each token, -1 where there's none."""
    at = word
    yield at
    for keys in strings:
        at = np.concatenate([[-1], _find(keys, _followed(words, at, word, doc))])
        yield at


def _followed(words: np.ndarray, at: np.ndarray, word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys of strings with the next word, for tokens from the second on; -1 where either isn't frequent.

    ``at`` are places of strings of a length; what ends in the next word has to be one of them itself,
    as no longer string can be more frequent than its parts.
    """
    use = (at[:-1] >= 0) & (at[1:] >= 0) & (doc[:-1] == doc[1:])
    return np.where(use, at[:-1] * len(words) + word[1:], -1)


def _strings(words: np.ndarray, strings: list[np.ndarray]):
    """Chunks -> counts in training documents of strings one word longer than the longest given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, place, doc = _unpacked(row)
                word = _find(words, tokens)[place]
                learnt = ~np.array(row["held"], bool)[doc]
                for at in _places(words, strings, word, doc):  # noqa: B007
                    pass
                key = _followed(words, at, word, doc)
                key, n = np.unique(key[(key >= 0) & learnt[1:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    return run


def _frequent(counted: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of at least ``least``, sorted by key: no more than tokens / least rows."""
    rows = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _node(context: np.ndarray, seen: np.ndarray, total: np.ndarray, below: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether nodes are retained, log10 probabilities of their listed words, and of the rest.

    ``below`` is the probability of each listed next word at the node's suffix. The test:
    twice the log-likelihood ratio of the next-word distributions (listed words and the rest)
    against its mean and three standard deviations under equal distributions.
    """
    p = (seen - DISCOUNT) / total[context]
    by_node = lambda x: np.bincount(context, x, minlength=nodes).astype(float)
    listed, mass, under = by_node(None), by_node(seen / total[context]), by_node(below)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = by_node(seen * np.log(seen / total[context] / below))
        rest = total * (1 - mass)
        gain += np.where(rest > 0, rest * np.log((1 - mass) / np.maximum(1 - under, 1e-12)), 0)
        kept = (listed > 0) & (2 * gain > listed + 3 * np.sqrt(2 * listed) + 10)
        spare = 1 - by_node(p)
        backed = np.log10(spare / np.maximum(1 - under, 1e-12))
    return kept, np.log10(p), np.where(kept, backed, np.nan)


def grow(chunks: DataFrame, roots: DataFrame, tokens: int, singles: int, depth: int = DEPTH, nodes: int = NODES) -> Tree:
    """The retained tree of the training documents."""
    least = max(LEAST, tokens ** (2 / 3) / nodes)
    words, count = _frequent(roots.select(F.col("token").alias("key"), F.col("c").alias("n")), least)
    order = np.argsort(words.view(np.uint64))
    words, count = words.view(np.uint64)[order], count[order].astype(float)
    n, table = len(words), chunks.select("held", "counts", "places", "tokens")
    # by string of the last length: its count, whether it is a node, its suffix, its last word's probability at the node before it
    total, suffix, p = count, np.zeros(n, np.int64), (1 - unknown_share(tokens, singles)) * count / max(tokens, 1)
    strings, levels, kept_before = [], [], np.ones(1, bool)
    for _ in range(depth if n else 0):
        keys, seen = _frequent(table.mapInArrow(_strings(words, strings), "key bigint, n bigint"), least)
        if not len(keys):
            break
        node, last = keys // n, keys % n
        # a string's suffix leaves out its first word: the suffix of its node, followed by its last word
        tail = _find(strings[-1], suffix[node] * n + last) if strings else last
        kept, log, rest = _node(node, seen, total, p[tail], len(total))
        kept &= kept_before[suffix]  # a node's suffix is a node
        levels.append(Level(keys, np.where(kept[node], log, np.nan), np.where(kept, rest, np.nan)))
        p = np.where(kept[node], 10**log, p[tail])
        total, suffix, kept_before = seen.astype(float), tail, kept
        strings.append(keys)
    return Tree(words, tuple(levels))


def unknown_share(tokens: int, singles: int) -> float:
    """Good and Turing's share of words not seen in training, as one symbol."""
    return (singles + 0.5) / (tokens + 1)


def log_probabilities(tree: Tree, tokens: np.ndarray, place: np.ndarray, doc: np.ndarray, root: np.ndarray) -> np.ndarray:
    """log10 probability of every token given those before it in its document."""
    out = root[place].copy()
    if len(out) < 2 or not len(tree.words):
        return out
    word = _find(tree.words, tokens)[place]
    ends = _places(tree.words, [level.keys for level in tree.levels], word, doc)
    at = next(ends)
    for level, longer in zip(tree.levels, ends, strict=True):
        node = np.where(doc[:-1] == doc[1:], at[:-1], -1)
        rest = np.where(node >= 0, level.rest[node], np.nan)
        listed = np.where(longer[1:] >= 0, level.log[longer[1:]], np.nan)
        out[1:] = np.where(np.isnan(rest), out[1:], np.where(np.isnan(listed), rest + out[1:], listed))
        at = longer
    return out


def _scored(tree: Tree, tokens: int, distinct: int, singles: int, id_type: pa.DataType):
    """A chunk and its tokens' training counts -> a row per document."""

    def run(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        out, n_docs = [], 0
        c = np.zeros(len(counts), np.int64)
        c[counts["place"].to_numpy() & ((1 << _PLACE_BITS) - 1)] = counts["c"].to_numpy()
        for row in chunk.to_pylist():
            values, place, doc = _unpacked(row)
            n_docs = len(row["doc_ids"])
            base = np.log10((c + ADDED) / (tokens + ADDED * (distinct + 1)))
            unknown = unknown_share(tokens, singles)
            root = np.log10(np.where(c > 0, (1 - unknown) * c / max(tokens, 1), unknown))
            total = lambda x: np.bincount(doc, x, minlength=n_docs)  # noqa: B023, E731
            score = total(log_probabilities(tree, values, place, doc, root))
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], id_type), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(row["counts"], pa.int64()), "n_known": total(c[place] > 0).astype(np.int64), "train_tokens": np.full(n_docs, tokens, np.int64), "base_score": total(base[place]), "score": score}))
        return pa.concat_tables(out)

    return run


def suffix_tree_scores(docs: DataFrame, depth: int = DEPTH, nodes: int = NODES) -> DataFrame:
    """Score every text by a tree of the documents whose crc32(doc_id) modulo 10 isn't 0.

    Returns a row per row of ``docs`` (doc_id and text are read, other columns may have any names):
    doc_id, held_out, n_tokens (words and one end), n_known (those seen in training), train_tokens, base_score
    (log10 by word frequencies with 0.1 added), score (log10 of the text by the tree). A word not seen in
    training is one symbol for both models.

    A chunk of documents keeps its distinct words once; their counts are joined by word, so
    a frequent word is one row per chunk. Words are known by a 64-bit hash. Null and empty
    texts are an end alone. Null ids are held out. Repeated rows are learnt and scored row by row.
    Without training tokens the base score is 0. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType
    src = docs.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    schema = f"chunk bigint, doc_ids array<{kind.simpleString()}>, held array<boolean>, counts array<bigint>, places binary, tokens array<bigint>, learnt array<bigint>"
    chunks = written(src.mapInArrow(_chunks(to_arrow_type(kind)), schema), "chunks")
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("tokens", "learnt")).alias("i", "t")).select((F.shiftleft("chunk", _PLACE_BITS) + F.col("i")).alias("place"), F.col("t.tokens").alias("token"), F.col("t.learnt").alias("learnt"))
    roots = written(each.where("learnt > 0").groupBy("token").agg(F.sum("learnt").alias("c")), "roots")
    size = roots.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0)).alias("singles")).first()
    tree = grow(chunks, roots, size["tokens"], size["singles"], depth, nodes)
    counts = each.select("place", "token").join(roots, "token", "left").select(F.shiftright("place", _PLACE_BITS).alias("chunk"), "place", F.coalesce("c", F.lit(0)).alias("c"))
    left = chunks.select("chunk", "doc_ids", "held", "counts", "places", "tokens").groupBy("chunk")
    out = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return left.cogroup(counts.groupBy("chunk")).applyInArrow(_scored(tree, size["tokens"], size["distinct"], size["singles"], to_arrow_type(kind)), out)
