"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, groups.

SuperMinHash (Ertl 2017): every element draws a random permutation of the m
components and lowers component p(j) to j + u_j, u_j uniform; as the ranks of one
element are a permutation, components are negatively correlated and the Jaccard
estimate has less variance than that of independent minima. A text stops
as soon as no component is above the rank reached, as later ranks can't lower it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesift.llm.components import connected_components
from cuesift.llm.storage import remove, written
from cuesift.llm.words import PIECE, is_long, mix, pieces, shingle_hashes, word_hashes

ROWS, BANDS = 4, 32


def super_minhash(elements: np.ndarray, text: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Signatures (n_texts, m) of sets: ``elements`` are hashes, ``text`` the set of each.

    A component holds rank * 2^32 + fraction; a set without elements has all ones. One set of many
    elements is signed in parts, whose least components are those of the whole.
    """
    if n_texts == 1 and len(elements) > PIECE:
        return np.min([super_minhash(elements[a : a + PIECE], text[a : a + PIECE], 1, m) for a in range(0, len(elements), PIECE)], axis=0)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n_texts * m, top, np.uint64)
    order = None
    for rank in range(m):
        draw = mix(elements + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
        to = (rank + ((draw >> np.uint64(32)) % np.uint64(m - rank))).astype(np.int64)
        value = (draw & np.uint64(0xFFFFFFFF)) | (np.uint64(rank) << np.uint64(32))
        if rank == 0:
            at, first = to, to
        else:
            if order is None:  # the state after the first swap, for those that go on
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
                row = np.arange(len(elements))
                order[row, 0], order[row, first] = first, 0
            row = np.arange(len(elements))
            at = order[row, to].astype(np.int64)
            order[row, to] = order[row, rank]
        np.minimum.at(sig, text * m + at, value)
        open_ = sig.reshape(n_texts, m).max(1) >= np.uint64(rank + 1) << np.uint64(32)
        go = open_[text]
        if not go.any():
            break
        if not go.all():
            elements, text = elements[go], text[go]
            first = first[go] if rank == 0 else first
            order = None if order is None else order[go]
    return sig.reshape(n_texts, m)


def _joined(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, each text's number of them, and bounds."""
    words, bounds = word_hashes(data, offsets)
    if is_long(data, offsets):
        runs = [words[a : a + PIECE + k - 1] for a in range(0, max(1, len(words) - k + 1), PIECE)]
        whole = np.unique(np.concatenate([np.unique(shingle_hashes(run, np.array([0, len(run)]), k)[0]) for run in runs]))
        return whole, np.array([len(whole)], np.int64), np.array([0, len(whole)])
    h, bounds = shingle_hashes(words, bounds, k)
    sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    size = np.array([len(x) for x in sets], np.int64)
    return np.concatenate(sets), size, np.concatenate([[0], np.cumsum(size)])


def _set_ids(elements: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set, the same for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    return mix((total[edge[1:]] - total[edge[:-1]]) ^ mix(np.diff(edge).astype(np.uint64))).view(np.int64)


def _signed(k: int, bands: int, rows: int):
    """doc_id, text -> doc_id, n, set_id and one hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in pieces(batch["text"]):
                all_, size, edge = _joined(data, offsets, k)
                text = np.repeat(np.arange(len(size)), size)
                sig = super_minhash(all_, text, len(size), bands * rows)
                h = np.zeros((len(size), bands), np.uint64)
                for r in range(rows):
                    h = mix(h + sig[:, r::rows] + np.uint64(r + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(start, end - start),
                        pa.array(size),
                        pa.array(_set_ids(all_, edge)),
                        pa.ListArray.from_arrays(np.arange(0, bands * len(size) + 1, bands, dtype=np.int32), h.view(np.int64).ravel()),
                    ],
                    names=["doc_id", "n", "set_id", "bands"],
                )

    return run


def _shingled(k: int):
    """text -> set_id and the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch["text"]):
                all_, _, edge = _joined(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_set_ids(all_, edge)), pa.ListArray.from_arrays(edge.astype(np.int32), all_.view(np.int64))],
                    names=["set_id", "shingles"],
                )

    return run


#: Sets, and shingles of them, in a block of those compared with each other.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000


def _forest(percent: int):
    """One pair of blocks of a centre's sets -> links between groups, at most one less than groups."""

    def run(table: pa.Table) -> pa.Table:
        group = table["label"].to_numpy()
        side = table["block"].to_numpy() == table["i"].to_numpy()
        other = table["block"].to_numpy() == table["j"].to_numpy()
        lists = table["shingles"].combine_chunks()
        size = lists.value_lengths().to_numpy()
        of = np.repeat(np.arange(len(size)), size)
        values, place, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        use = often[place] > 1  # a shingle of one set adds to no intersection
        column = (np.cumsum(often > 1) - 1)[place[use]]
        of, order = of[use], np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        common = np.zeros((len(size), len(size)))  # sums of whole numbers in double precision are exact
        for start in range(0, int((often > 1).sum()), 2048):
            a, b = np.searchsorted(column, [start, start + 2048])
            x = np.zeros((len(size), 2048), np.float32)
            x[of[a:b], column[a:b] - start] = 1
            common += x @ x.T
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        linked &= (side[:, None] & other[None, :]) & (group[:, None] != group[None, :])
        a, b = np.nonzero(linked)
        names, at = np.unique(group, return_inverse=True)
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for u, v in np.unique(np.sort(np.stack([at[a], at[b]], 1), axis=1), axis=0).tolist():
            if root(u) != root(v):
                parent[root(u)] = root(v)
                out.append((names[u], names[v]))
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    return run


def _rest(pairs: DataFrame, label: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links between groups among sets that were compared with the same centre.

    Centres all of whose sets are in one group are left out. A centre's sets are dealt to blocks
    by hash; a set goes to each pair of blocks that has its own, so a row is copied
    as often as its centre has blocks.
    """
    of = pairs.select(F.col("a").alias("centre"), F.col("b").alias("id"), F.col("b_n").alias("n")).join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    whole = of.groupBy("centre").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("sets"), F.sum("n").alias("total")).where("lo != hi")
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    of = of.join(whole.select("centre", blocks.alias("blocks")), "centre").withColumn("block", F.pmod(F.xxhash64("id", "centre"), "blocks").cast("int"))
    of = of.join(shingles.withColumnRenamed("set_id", "id"), "id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    of = of.select("centre", "label", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "shingles")
    return of.groupBy("centre", "i", "j").applyInArrow(_forest(percent), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Group documents whose sets of k-word shingles have a Jaccard similarity >= percent / 100.

    Returns one row per row of ``docs`` (only doc_id and text are read, other columns
    may have any names): doc_id, n_shingles, component_id (smallest doc_id that
    links reach), kept (doc_id = component_id).

    Steps: signatures and an id of the set for each document; one representative
    for each set, so exact copies cost one row; ``bands`` buckets of ``rows``
    components each. A bucket compares its sets with its smallest one only; then, of the sets
    compared with the same centre, those that aren't in one group by now are compared with
    each other, in blocks that return no more than a spanning forest. All links are
    confirmed on the full sets, and no pair of sets that share a bucket stays undecided.
    A pair at 0.8 misses all of 32 bands of 4 with a chance of 5e-8.

    Null text is empty; an empty set links with nothing, so such a document is kept.
    Null doc_ids come back with a null component_id and kept = true, each on its own.
    Rows that repeat a doc_id are judged by their own text; repeated rows agree. An empty
    table gives no rows. Very long texts are read whole.
    """
    src = docs.select("doc_id", "text")
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n bigint, set_id bigint, bands array<bigint>"
    signed = written(src.mapInArrow(_signed(k, bands, rows), schema), "signed")
    full = signed.where("n > 0 and doc_id is not null")
    sets = written(full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "sets")
    of_set = full.join(sets, ["set_id", "doc_id"]).dropDuplicates(["set_id"]).select(F.col("set_id").alias("id"), "n", F.posexplode("bands").alias("band", "h"))
    of_set = of_set.select(F.xxhash64("band", "h").alias("key"), "id", "n")
    shared = of_set.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("key")
    members = written(of_set.join(shared, "key"), "members")

    wanted = members.select(F.col("id").alias("set_id")).distinct().join(sets, "set_id")
    texts = src.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    shingles = written(texts.mapInArrow(_shingled(k), "set_id bigint, shingles array<bigint>").dropDuplicates(["set_id"]), "shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        a = shingles.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
        b = shingles.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
        return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")

    # every bucket compares its members with its smallest id
    centre = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"))
    pairs = members.join(centre, "key").select(F.col("c.id").alias("a"), F.col("id").alias("b"), F.col("c.n").alias("a_n"), F.col("n").alias("b_n"))
    pairs = written(pairs.where("a != b").distinct(), "pairs")
    close = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
    links = written(verify(pairs.where(close).select("a", "b")).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    label = connected_components(links)
    more = written(_rest(pairs, label, shingles, percent), "links")
    label = connected_components(links.unionByName(more))
    named = sets.join(label.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = written(named.join(least, "label").select("set_id", "component_id"), "named")
    for x in (members, shingles, pairs, links, more):
        remove(x)
    out = signed.drop("bands").join(named, "set_id", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
