"""Embedding near-duplicates by sorted projection passes.

Each pass hashes a vector to the signs of random projections, most significant first, and orders
all vectors by them; a vector is compared with a bounded number of its neighbours in that order.
Passes differ in their projections. Links found in any pass are united; then the links
within each component are counted exactly, a block against a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cuesift.llm.components import connected_components
from cuesift.llm.storage import drop_shuffles, remove, written

PASSES, WINDOW, BITS = 12, 128, 60
THRESHOLD = 0.9
#: Chance that a pair at the threshold is found, by which passes beyond ``PASSES`` are added as vectors grow.
RECALL = 0.999
#: Vectors of a component in a block, and sorted rows to a partition of a pass at least.
BLOCK, PARTITION_ROWS = 1024, 4096
#: Passes in one exchange.
AT_ONCE = 12


def passes_for(count: int, threshold: float = THRESHOLD, window: int = WINDOW, least: int = PASSES, recall: float = RECALL) -> int:
    """Passes after which a pair at ``threshold`` among ``count`` vectors has been neighbours with a chance of ``recall``.

    A pair is in one window if it agrees on the first signs that part the vectors into runs
    of the window's length; it agrees on a sign with a chance of 1 - angle / pi.
    """
    agree = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    found = agree ** max(0.0, np.log2(max(count, 1) / window))
    return least if found >= 1 else max(least, int(np.ceil(np.log(1 - recall) / np.log1p(-found))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision; all lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(passes: range, dim: int, seed: int):
    """id, embedding -> a row per pass with the projections' signs as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch["embedding"])
            for p in passes:
                planes = np.random.default_rng([seed, p, dim]).standard_normal((dim, BITS))
                key = ((x @ planes) >= 0) @ bits
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p, np.int32)), pa.array(key), batch["id"], batch["embedding"]], names=["turn", "key", "id", "embedding"])

    return run


def _labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row that it is connected to."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _near(turn: np.ndarray, ids: np.ndarray, x: np.ndarray, new: int, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted rows at most ``window`` apart, each with one of the rows from ``new`` on."""
    out = []
    for a in range(0, len(ids), window):
        b = min(a + 2 * window, len(ids))
        if b <= new or b - a < 2:
            continue
        linked = (x[a:b] @ x[a:b].T >= threshold) & (turn[a:b, None] == turn[None, a:b])
        gap = np.abs(np.arange(b - a)[:, None] - np.arange(b - a)[None, :])
        linked &= gap <= window
        if linked.sum() > b - a:
            label = _labels(linked)
            moved = np.flatnonzero(label != np.arange(b - a))
            out.append(np.stack([ids[a:b][moved], ids[a:b][label[moved]]], 1))
    found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return found[:, 0], found[:, 1]


_FOUND = "u bigint, v bigint, border int, place int, turn int, embedding {kind}"


def _windows(window: int, threshold: float, kind: pa.DataType):
    """Sorted rows -> links, and copies of a partition's first and last rows for its borders."""

    def rows(u, v, border, place, turn, embedding) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(n, border, np.int32)), pa.array(place, pa.int32()), pa.array(turn, pa.int32()), embedding],
            names=["u", "v", "border", "place", "turn", "embedding"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kept, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            batch = pa.Table.from_batches([batch]).select(["turn", "id", "embedding"])
            table = batch if kept is None else pa.concat_tables([kept, batch])
            old = 0 if kept is None else len(kept)
            u, v = _near(table["turn"].to_numpy(), table["id"].to_numpy(), _matrix(table["embedding"]), old, window, threshold)
            yield rows(u, v, -1, np.zeros(len(u), np.int32), np.zeros(len(u), np.int32), pa.nulls(len(u), kind))
            if first is None or len(first) < window:
                first = (batch if first is None else pa.concat_tables([first, batch])).slice(0, window)
            kept = table.slice(max(0, len(table) - window))
        if kept is not None:
            for part, border, start in ((kept, here + 1, -len(kept)), (first, here, 0)):
                yield rows(part["id"].to_numpy(), np.zeros(len(part), np.int64), border, np.arange(len(part), dtype=np.int32) + np.int32(start), part["turn"].to_numpy(), part["embedding"].combine_chunks())

    return run


def _border(window: int, threshold: float):
    """The last rows of a partition and the first of the next -> links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        u, v = _near(table["turn"].to_numpy(), table["u"].to_numpy(), _matrix(table["embedding"]), 0, window, threshold)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _counted(threshold: float):
    """Two blocks of a component -> for each vector, the vectors of the other block that it links with."""

    def run(table: pa.Table) -> pa.Table:
        ids, weight, x = table["id"].to_numpy(), table["copies"].to_numpy().astype(np.float64), _matrix(table["embedding"])
        block, i, j = (table[c].to_numpy() for c in ("block", "i", "j"))
        one, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = x[one] @ x[other].T >= threshold
        if i[0] == j[0]:
            np.fill_diagonal(linked, False)
            return pa.table({"id": ids[one], "n": (linked @ weight[other]).astype(np.int64)})
        n = np.concatenate([linked @ weight[other], weight[one] @ linked]).astype(np.int64)
        return pa.table({"id": np.concatenate([ids[one], ids[other]]), "n": n})

    return run


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, seed: int = 11) -> DataFrame:
    """Group vectors with a cosine of at least ``threshold``, in double precision.

    One row per row of ``vectors`` (vec_id and embedding are read, other columns may have
    any names): vec_id, n_links (other vectors it links with directly), component_id (smallest
    vec_id reachable), kept (vec_id = component_id).

    Equal embeddings (compared themselves, not by hash) are one item with a number of copies. A pass sorts all items;
    links across the borders of its partitions are looked for in a second step. A cosine
    of 0.9 agrees on a sign with a chance of 0.86, so a pair is neighbours in one of the passes with
    a chance that grows with its cosine; ``passes`` are the least number, and
    ``passes_for`` adds to them by the number of vectors; no link below the threshold is ever made.
    n_links are exact within a component.

    Null embeddings, those with null or non-finite components and zero vectors link with
    nothing, as do rows with a null vec_id (component_id null, kept). Lengths may differ: vectors
    of unlike length don't link. An empty table gives no rows.
    """
    good = "embedding is not null and vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x != 0)"
    src = vectors.select("vec_id", "embedding").withColumn("item", F.expr(f"case when {good} then xxhash64(embedding) end"))
    kind_name = vectors.schema["embedding"].dataType.simpleString()
    items = src.where("item is not null").groupBy("item", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # unlike embeddings that share a hash are numbered, so that no link rests on a hash alone
    same = Window.partitionBy("item")
    items = items.withColumn("_n", F.row_number().over(same.orderBy("embedding"))).withColumn("clash", F.count("*").over(same) > 1)
    items = items.withColumn("id", F.when(F.col("_n") == 1, F.col("item")).otherwise(F.xxhash64("item", "_n"))).drop("_n")
    items = written(items.withColumn("dim", F.size("embedding")), "items")
    edges, scratch = None, [items]
    for row in items.groupBy("dim").count().collect():  # one round for each length of vector
        some = items.where(F.col("dim") == row["dim"]).select("id", "embedding")
        kind = to_arrow_type(vectors.schema["embedding"].dataType)
        turns = passes_for(row["count"], threshold, window, passes)
        for first in range(0, turns, AT_ONCE):  # passes that are sorted together, so that the disk holds copies for no more
            some_turns = range(first, min(first + AT_ONCE, turns))
            keyed = some.mapInArrow(_hashed(some_turns, row["dim"], seed), f"turn int, key bigint, id bigint, embedding {kind_name}")
            parts = max(1, min(row["count"] * len(some_turns) // PARTITION_ROWS, 100_000))
            ordered = keyed.repartitionByRange(parts, "turn", "key", "id").sortWithinPartitions("turn", "key", "id")
            found = written(ordered.mapInArrow(_windows(window, threshold, kind), _FOUND.format(kind=kind_name)), "found")
            border = found.where("border >= 0").groupBy("border").applyInArrow(_border(window, threshold), "u bigint, v bigint")
            links = written(found.where("border < 0").select("u", "v").unionByName(border).distinct(), "links")
            edges = links if edges is None else edges.unionByName(links)
            remove(found)
            scratch.append(links)
            del keyed, ordered, border
            drop_shuffles(vectors.sparkSession)
    if edges is None:
        label = items.select("id", F.col("id").alias("label"))
        n = items.select("id", F.lit(0).cast("long").alias("n")).where("false")
    else:
        label = connected_components(edges)
        size = label.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        of = label.join(size, "label").withColumn("block", F.pmod(F.xxhash64("id", "label"), "blocks").cast("int"))
        of = of.join(items.select("id", "copies", "embedding"), "id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        of = of.select("label", "id", "copies", "embedding", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
        n = of.groupBy("label", "i", "j").applyInArrow(_counted(threshold), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    told = F.when(F.col("clash"), F.col("embedding")).alias("told")
    named = items.select("id", "item", "least", "copies", told).join(label, "id", "left").withColumn("label", F.coalesce("label", "id")).join(n, "id", "left")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "label").select("item", "told", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    for x in scratch:
        remove(x)
    src = src.withColumnRenamed("item", "_item")
    out = src.join(named, (F.col("_item") == F.col("item")) & (F.col("told").isNull() | (F.col("told") == F.col("embedding"))), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
