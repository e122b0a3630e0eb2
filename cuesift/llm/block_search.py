"""Nearest vectors by inner product: a block matrix join over int8 codes.

Every vector is known by int8 codes, a scale, its length and the length of what the codes lose. A
tile is a block of queries against a block of candidates: the product of the codes gives each inner
product with a bound of its error, and only pairs that may belong to a query's nearest survive.
Survivors are recomputed from the vectors themselves and merged by a heap for each query, so that
the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesift.llm.storage import remove, written

NEAREST = 20
#: Queries in a block; a task holds their codes and their best bounds.
QUERIES = 16_384
#: Blocks of candidates at least, and candidates in a block at most: each block returns a query's nearest in it.
SLICES, MOST_SLICE = 8, 1 << 20
#: Rows and columns of a tile that are multiplied at once.
TILE_ROWS, TILE_COLUMNS = 512, 2048
#: Products of codes are whole numbers below 2^24 over so many components, exact in single precision.
EXACT_WIDTH = 1024
#: Of the product of both lengths: more than double precision can lose.
SLACK = 1e-9
#: Queries whose survivors are merged by one task at a time.
MERGED = 16

_CODED = "id bigint, dim int, asks boolean, code binary, scale double, lost double, size double"


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of list: their places and their values in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield at, flat[start[at, None] + np.arange(d)]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows -> int8 codes, scales, lengths of what the codes lose, lengths of the rows."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).clip(-127, 127).astype(np.int8)
    lost = x - scale[:, None] * code
    return code, scale, np.sqrt((lost * lost).sum(1)), np.sqrt((x * x).sum(1))


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, x in _by_length(batch["embedding"]):
            code, scale, lost, size = quantised(x)
            n, d = code.shape
            codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * d).astype(np.int32)), pa.py_buffer(code.tobytes())])
            own = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([own["id"], pa.array(np.full(n, d, np.int32)), own["asks"], codes, pa.array(scale), pa.array(lost), pa.array(size)], names=["id", "dim", "asks", "code", "scale", "lost", "size"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two blocks of codes, exact in double precision."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_WIDTH):
        out += a[:, at : at + EXACT_WIDTH].astype(np.float32) @ b[:, at : at + EXACT_WIDTH].astype(np.float32).T
    return out


class _Side:
    """One side of a group of tiles."""

    def __init__(self, table: pa.Table):
        self.ids = table["id"].to_numpy()
        column = table["code"].combine_chunks()
        flat = np.frombuffer(b"".join(column.to_pylist()), np.int8)
        self.code = flat.reshape(len(self.ids), -1) if len(self.ids) else np.zeros((0, 0), np.int8)
        self.scale, self.lost, self.size = (table[c].to_numpy() for c in ("scale", "lost", "size"))


def _bounds(q: _Side, rows: slice, c: _Side, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each pair of a tile can have."""
    with np.errstate(invalid="ignore", over="ignore"):
        about = _products(q.code[rows], c.code[columns]) * q.scale[rows, None] * c.scale[None, columns]
        # <q, c> - <q', c'> = <q, c - c'> + <q - q', c'>, each at most the product of both lengths
        most = q.size[rows, None] * c.lost[None, columns] + q.lost[rows, None] * (c.size + c.lost)[None, columns]
        most += SLACK * q.size[rows, None] * c.size[None, columns]
        low, high = about - most, about + most
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def _tiles(keep: int):
    """A block of queries and a block of candidates -> pairs that may be among a query's ``keep`` nearest."""

    def run(table: pa.Table) -> pa.Table:
        asks = table["asking"].to_numpy(zero_copy_only=False).astype(bool)
        q, c = _Side(table.filter(pa.array(asks))), _Side(table.filter(pa.array(~asks)))
        found = []
        for top in range(0, len(q.ids) if len(c.ids) else 0, TILE_ROWS):
            rows = slice(top, min(top + TILE_ROWS, len(q.ids)))
            best, parts = np.full((rows.stop - top, keep), -np.inf), []
            for left in range(0, len(c.ids), TILE_COLUMNS):
                columns = slice(left, min(left + TILE_COLUMNS, len(c.ids)))
                low, high = _bounds(q, rows, c, columns)
                best = -np.partition(-np.concatenate([best, low], 1), keep - 1, 1)[:, :keep]
                i, j = np.nonzero(high >= best.min(1)[:, None])
                parts.append((i, j + left, low[i, j], high[i, j]))
            i, j, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
            some = high >= best.min(1)[i]
            found.append((q.ids[rows][i[some]], c.ids[j[some]], low[some], high[some]))
        a, b, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
        return pa.table({"q": a, "c": b, "low": low, "high": high})

    return run


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each pair of rows, components added one after the other."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _merge(keep: int):
    """Survivors of some queries with both vectors -> each query's nearest ids, from a heap."""

    def run(table: pa.Table) -> pa.Table:
        score = np.zeros(len(table))
        both = zip(_by_length(table["embedding"]), _by_length(table["other"]), strict=True)  # alike in length, pair by pair
        for (at, x), (_, y) in both:
            score[at] = inner_products(x, y)
        heaps: dict[int, list[tuple[float, int, bool]]] = {}
        for q, c, s, ids in zip(table["q"].to_pylist(), table["c"].to_pylist(), score.tolist(), table["ids"].to_pylist(), strict=True):
            heap = heaps.setdefault(q, [])
            for x in ids:
                entry = (s, -x, q == c)
                if len(heap) < keep:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                else:
                    break  # ids rise, so no later one is nearer
        near = [[{"score": s, "vec_id": -x, "same": same} for s, x, same in sorted(heap, reverse=True)] for heap in heaps.values()]
        kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("same", pa.bool_())]))
        return pa.table({"q": pa.array(list(heaps), pa.int64()), "near": pa.array(near, kind)})

    return run


def _items(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with an id, their ``keep`` smallest vec_ids and whether one of theirs asks."""
    same = Window.partitionBy("embedding")
    first = rows.withColumn("_n", F.row_number().over(same.orderBy("vec_id"))).where(F.col("_n") <= keep)
    items = first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where("asks").select("embedding").distinct().withColumn("asks", F.lit(True))
    items = items.join(asked, "embedding", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    # unlike vectors that share a hash are numbered
    items = items.withColumn("_h", F.xxhash64("embedding"))
    items = items.withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy("embedding")))
    return items.withColumn("id", F.when(F.col("_n") == 1, F.col("_h")).otherwise(F.xxhash64("_h", "_n"))).drop("_h", "_n")


def nearest(vectors: DataFrame, asks: Column, k: int = NEAREST) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row that ``asks``.

    One row per query and rank: query_id, rank (from 1), vec_id, score (double precision on the original
    components), nearest first, equal scores by the smaller vec_id. All other rows are candidates and fewer
    than ``k`` of them are all returned. The result is exact: bounds only leave out
    pairs that ``k`` others surely beat.

    vec_id and embedding are read, and what ``asks`` reads; other columns may have any names. Null or empty
    embeddings, zero vectors, those with null or non-finite components and rows with a null vec_id take no part.
    Repeated rows (equal vec_id and embedding) count once; a row with the query's vec_id and another embedding
    is a candidate like any other. Vectors of unlike length aren't compared. An empty table gives no rows.

    Copies of a vector are one item, in the search as queries and as candidates, with their ``k`` + 1 smallest
    vec_ids: no other copy can be among the nearest.
    """
    keep = k + 1  # the query itself may be among its nearest
    good = "embedding is not null and vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x != 0)"
    rows = vectors.select("vec_id", "embedding", F.coalesce(asks, F.lit(False)).alias("asks")).where(good)
    rows = written(rows.groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks")), "rows")
    items = written(_items(rows, keep), "items")
    coded = written(items.select("id", "asks", "embedding").mapInArrow(_quantise, _CODED), "codes")
    count = coded.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("m"))
    count = count.select("dim", F.ceil(F.col("m") / QUERIES).alias("tops"), F.greatest(F.ceil(F.col("n") / MOST_SLICE), F.lit(SLICES)).alias("lefts"))
    sized = coded.join(F.broadcast(count.where("tops > 0")), "dim")  # a row for each length of vector
    cast = [F.col(c).cast("int").alias(c) for c in ("tops", "lefts")]
    sized = sized.select(*coded.columns, *cast)
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["id", "code", "scale", "lost", "size"]
    queries = sized.where("asks").select("dim", part("tops", 1).alias("i"), every("lefts").alias("j"), F.lit(True).alias("asking"), *cols)
    candidates = sized.select("dim", every("tops").alias("i"), part("lefts", 2).alias("j"), F.lit(False).alias("asking"), *cols)
    pairs = queries.unionByName(candidates).groupBy("dim", "i", "j").applyInArrow(_tiles(keep), "q bigint, c bigint, low double, high double")
    by = Window.partitionBy("q")
    pairs = pairs.withColumn("_n", F.row_number().over(by.orderBy(F.desc("low")))).withColumn("_t", F.min(F.when(F.col("_n") <= keep, F.col("low"))).over(by))
    pairs = written(pairs.where("high >= _t").select("q", "c"), "pairs")
    named = items.select(F.col("id").alias("c"), "ids", F.col("embedding").alias("other"))
    full = pairs.join(named, "c").join(items.select(F.col("id").alias("q"), "embedding"), "q")
    groups = items.where("asks").count() // MERGED + 1
    near = full.withColumn("_b", F.pmod(F.xxhash64("q"), F.lit(groups))).groupBy("_b").applyInArrow(_merge(keep), "q bigint, near array<struct<score: double, vec_id: bigint, same: boolean>>")
    # q's numbers are those of the items; the query rows of an item share its nearest
    near = near.join(items.where("asks").select(F.col("id").alias("q"), "embedding"), "q").drop("q")
    out = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").join(near, "embedding")
    out = out.select("query_id", F.slice(F.filter("near", lambda x: ~(x["same"] & (x["vec_id"] == F.col("query_id")))), 1, k).alias("near"))
    out = written(out.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score"), "nearest")
    for table in (coded, pairs, items, rows):
        remove(table)
    return out


def nearest_of_twentieth(vectors: DataFrame) -> DataFrame:
    """The query's search: rows whose vec_id is divisible by 20 against all rows."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)


#: The nearest rows by comparing each query with every row.
NEAREST_SQL = """
with good as (
  select distinct vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from good q join good c on q.vec_id % 20 = 0 and len(q.e) = len(c.e) and (q.vec_id, q.e) <> (c.vec_id, c.e)
), ranked as (
  select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
"""
