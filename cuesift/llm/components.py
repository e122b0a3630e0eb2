"""Connected components, and groups of linked items from candidate buckets.

Everything here is DataFrame operations; no link, label or member is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesift.llm.storage import remove, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (id, label): each linked node with the smallest node it reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); a round is
    two aggregations and two joins by node, a hub's rows being split by the
    skew join. Nodes without links aren't returned. Self links and repeated
    links are harmless; null ends are dropped; no links give no rows.
    """
    now = written(edges.select("u", "v").where("u != v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen, before = mark, now
        now = written(_small_star(_large_star(before)), "edges")
        remove(before)
    out = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
    out = out.unionByName(out.select(F.col("label").alias("id"), "label").distinct())
    out._path = now._path
    return out


def _merged(label: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels after more links (u, v): only groups that the links join are looked at again."""
    if label is None:
        return connected_components(found)
    named = lambda end: label.select(F.col("id").alias(end), F.col("label").alias(f"_{end}"))
    ends = found.join(named("u"), "u", "left").join(named("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    moved = connected_components(ends)
    to = moved.select(F.col("id").alias("label"), F.col("label").alias("to"))
    old = label.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return written(old.unionByName(moved.join(label.select("id"), "id", "left_anti")), "labels")


def bucket_groups(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    rest: Callable[[DataFrame], DataFrame],
    pair_filter: str = "true",
    stars: int = 4,
    fruitful: float = 0.0,
    few: int = 0,
    tidy: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Groups of ids that verified links connect, candidates being pairs in a bucket.

    ``members``: (key, id, and any columns that ``pair_filter`` compares as a_x, b_x);
    an id may be in many buckets. ``verify`` takes distinct pairs (a, b) with a < b
    and returns those that link. Returns (id, label) for ids with a link, label
    being the smallest id of the group.

    The groups are exactly those of all verified pairs that share a bucket, but
    not all pairs are looked at: in each round every bucket compares its members
    with one centre only (rows in proportion to the members), and members already
    in the centre's group aren't compared. When few pairs of unlike groups
    are left (or after ``stars`` rounds, or a round in which less than the share ``fruitful`` of the pairs linked) ``rest`` takes (members' columns, group) of buckets with unlike groups and
    returns the links (u, v) among those without exception. It need not look at pairs with a bucket's smallest id, the first
    round's centre: those that link are in one group. Buckets of at most ``few`` members have one round: all their pairs cost ``rest``
    little, and more rounds over them much. ``tidy`` is called when a round's members are written, before its pairs are made.
    """
    cols = [c for c in members.columns if c not in ("key", "id")]
    ends = lambda t, p: t.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "group", *cols)])
    label = before = None
    size, idle = members.count(), False
    for turn in range(stars + 1):
        now = members.withColumn("group", F.col("id")) if label is None else members.join(label, "id", "left").withColumn("group", F.coalesce("label", "id")).drop("label")
        if turn:
            mixed = now.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo != hi").select("key")
            now = written(now.join(mixed, "key"), "mixed")
            if before is not None:
                remove(before)
            before, members = now, now.drop("group")  # a bucket in one group stays in one
            tidy()
            by = now.groupBy("key", "group").count().groupBy("key").agg(F.sum("count").alias("size"), (F.sum("count") * F.sum("count") - F.sum(F.col("count") * F.col("count"))).alias("n"))
            left, large = by.agg(F.sum(F.col("n").cast("decimal(38,0)")), F.count_if(F.col("size") > few)).first()
            if not left:
                break
            if turn == stars or idle or not large or left <= 4 * size:
                label = _merged(label, written(rest(now), "links"))
                break
            if few:
                now = now.join(by.where(F.col("size") > few).select("key"), "key")
        rank = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
        centre = now.groupBy("key").agg(F.min_by(F.struct("id", "group", *cols), rank).alias("c"))
        pairs = ends(now, "b").join(centre.select("key", *[F.col(f"c.{c}").alias(f"a_{c}") for c in ("id", "group", *cols)]), "key").where("a_group != b_group")
        pairs = written(pairs.where(pair_filter).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct(), "pairs")
        found = written(verify(pairs).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        idle = bool(fruitful) and found.count() < fruitful * pairs.count()
        remove(pairs)
        label = _merged(label, found)
    if before is not None:
        remove(before)
    return label
