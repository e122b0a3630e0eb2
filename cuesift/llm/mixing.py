"""Mixing sources to target weights with a time-varying curriculum.

Training time t in [0, 1] is the share of the mix's words that have been used. A source with target share a of the
mix has the share a (1 + g (2t - 1)) of it at time t: its weight rises or falls in a straight line, and shares
sum to 1 at any time as the slopes g have mean 0 by target. The integral, a (t + g (t^2 - t)), is the source's
cumulative demand; a document pass with demand u before its middle is due at the t that inverts it. Passes are range-sorted by
that position. Everything is DataFrame operations; running sums go over hash buckets, so no source has
to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets that a source's documents are summed in before a running sum over buckets.
BUCKETS = 4096
MOST_PASSES = 3
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text: runs of bytes other than space and the five control blanks; null is 0.

    Every word is cut to one letter and the blanks go, which leaves the count as a length.
    """
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, _WORD, "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, tilt) -> (source, weight, source_size, target, slope), one row per source.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes;
    no target is above 3 times its source's size. What a capped source can't take
    is shared by weight among the others, which is the level at which shares
    min(3 size, level x weight) use up the sum: the sources with the least size
    per weight are capped first, up to the first whose cap the level reaches.

    The tilt is (last - first) / (last + first) of a source's weights over time; null: sources of weight 1 rise
    from 1 to 3, those of 3 fall to 1. Slopes are tilts less their mean by target, scaled so that no share is negative.
    The windows here see one row per source, never a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sizes = sizes if "tilt" in sizes.columns else sizes.withColumn("tilt", F.lit(None).cast("double"))
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", MOST_PASSES * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    free = weighed.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    aimed = free.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("weight"), F.col("cap").cast("double"))))
    aimed = aimed.withColumn("tilt", F.coalesce("tilt", (2 - F.col("weight")) / 2))
    mean = F.coalesce(F.try_divide(F.sum(F.col("target") * F.col("tilt")).over(everything), F.sum("target").over(everything)), F.lit(0.0))
    aimed = aimed.withColumn("off", F.col("tilt") - mean)
    slope = F.col("off") / F.greatest(F.lit(1.0), F.max(F.abs("off")).over(everything))
    return aimed.select("source", "weight", "source_size", "target", slope.alias("slope"))


def _with_demand(sized: DataFrame) -> DataFrame:
    """Rows with size, _key and _tilt -> also source_size, target, weight, slope, and demand, the sizes before in the source.

    Documents of a source follow each other by md5 of id and text, so that null or repeated ids don't share a bucket.
    """
    sized = sized.withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.max("_tilt").alias("_tilts"))
    total = buckets.groupBy("source").agg(F.sum("_sum").alias("source_size"), F.max("_tilts").alias("tilt"))
    whole = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.withColumn("_base", F.coalesce(F.sum("_sum").over(whole), F.lit(0))).drop("_sum", "_tilts")
    base = base.withColumnRenamed("source", "_s").withColumnRenamed("_bucket", "_b")
    aim = targets(total).withColumnRenamed("source", "_t")
    base = base.join(aim, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = sized.withColumn("_inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = inner.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("demand", F.col("_base") + F.col("_inner")).drop("_s", "_b", "_base", "_inner", "_bucket", "_key", "_tilt")


def _key() -> Column:
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("")))).alias("_key")


def passes_of(size: Column, source_size: Column, target: Column, demand: Column) -> Column:
    """How often the mix takes a document: passes whose middle lies within the target, 0 to 3."""
    n = F.floor((target - demand - size / 2) / source_size) + 1
    return F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(MOST_PASSES), n))).otherwise(0).cast("int")


def due(u: Column, slope: Column) -> Column:
    """The time in [0, 1] by which a share ``u`` of a source's demand is used: the inverse of t + slope (t^2 - t)."""
    rate = 1 - slope
    root = (-rate + F.sqrt(F.greatest(F.lit(0.0), rate * rate + 4 * slope * u))) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, u).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))


def _passes(planned: DataFrame) -> DataFrame:
    """A row for each pass of each document with its ``position``; a document that isn't taken has one row with null."""
    n = passes_of(F.col("size"), F.col("source_size"), F.col("target"), F.col("demand"))
    each = planned.withColumn("_n", n).withColumn("_turn", F.explode_outer(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1))))
    u = (F.col("source_size") * F.col("_turn") + F.col("demand") + F.col("size") / 2) / F.col("target")
    return each.withColumn("position", F.when(F.col("_turn").isNotNull(), due(F.least(F.lit(1.0), u), F.col("slope"))))


def taken(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, first_position.

    The mix is made of ids and sizes alone, range-sorted by position, and added up by document: taken are the words of
    its passes, ``first_position`` is when the first is due (six digits; null if there is none).

    Only doc_id, text and source are read, so other columns may have any names. Null text has
    size 0, a null source is a source of its own (the last), null ids and
    repeated rows are counted row by row, an empty table gives no rows. Documents without words are
    never taken. Equal rows tie without consequence: their sizes are equal.
    """
    planned = _with_demand(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _key(), F.lit(None).cast("double").alias("_tilt")))
    mix = _passes(planned.withColumn("_row", F.monotonically_increasing_id()))
    mix = mix.select("_row", "doc_id", "size", "source_size", "target", "position").repartitionByRange("position", "_row").sortWithinPartitions("position", "_row")
    words = F.sum(F.when(F.col("position").isNotNull(), F.col("size")).otherwise(0))
    out = mix.groupBy("_row", "doc_id", "size", "source_size", "target").agg(words.alias("taken"), F.round(F.min("position"), 6).alias("first_position"))
    return out.drop("_row")


def curriculum(docs: DataFrame, first: Column | None = None, last: Column | None = None, partitions: int | None = None) -> DataFrame:
    """The mix itself: ``docs``, a row for each pass, with ``position``, range-sorted by it.

    ``first`` and ``last`` are a source's weights at the start and the end of training (expressions of
    docs' columns, the same for all rows of a source); a source whose weight rises comes late. Documents that the
    mix doesn't take are gone. ``position`` is the time at which a pass is due, in [0, 1];
    equal positions are ordered by id. Cases as in ``taken``; other columns are
    kept as they are, but one named position is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != "position"]
    tilt = F.lit(None).cast("double")
    if first is not None and last is not None:
        tilt = F.try_divide((last - first).cast("double"), (last + first).cast("double"))
    # the document's own columns travel in one struct, so that none can clash with those made here
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    planned = _with_demand(docs.select(row, "doc_id", "source", size_of(F.col("text")).alias("size"), _key(), tilt.alias("_tilt")))
    out = _passes(planned).where("position is not null").select(*[F.col("_row").getField(c).alias(c) for c in columns], "position")
    keys = [F.col("position"), F.col("doc_id")]
    out = out.repartitionByRange(partitions, *keys) if partitions else out.repartitionByRange(*keys)
    return out.sortWithinPartitions(*keys)


#: The same rows as ``taken``, in DuckDB SQL.
TAKEN_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(md5(text), '')) AS k FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / weight AS fill,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM sources WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
  SELECT source, source_size, (2 - weight) / 2.0::DOUBLE AS tilt, least(cap::DOUBLE, coalesce((SELECT arg_min(level, fill) FROM levels WHERE cap >= level * weight) * weight, cap::DOUBLE)) AS target FROM levels),
tilted AS (SELECT *, tilt - coalesce(sum(target * tilt) OVER () / nullif(sum(target) OVER (), 0), 0) AS off FROM capped),
aims AS (SELECT *, off / greatest(1.0::DOUBLE, max(abs(off)) OVER ()) AS g FROM tilted),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.g,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS demand
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN abs(g) < 1e-9 THEN u ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    (-(1 - g) + sqrt(greatest(0.0::DOUBLE, (1 - g) * (1 - g) + 4 * g * u))) / (2 * g))) END, 6) END AS first_position
FROM (SELECT *, least(1.0::DOUBLE, (demand + size / 2) / target) AS u,
  (CASE WHEN size > 0 THEN size * greatest(0, least(3, floor((target - demand - size / 2) / source_size) + 1)) ELSE 0 END)::BIGINT AS taken FROM placed)
"""
