"""Selection over videos that arrive as a stream of score files.

Medians, ranges and forward gates need a whole timeline, so a video is selected when its end
marker has arrived. Frames are appended to a table as they come, dealt to folders by a hash of the video;
a micro-batch that brings end markers reads the folders of those videos only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "video_id string, frame_idx int, expert string, query string, score double, is_end boolean"
#: Folders that videos are dealt to.
SLOTS = 64


def select_on_end(spark: SparkSession, source: str, table: str, out: str, checkpoint: str, choose: Callable[[DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Read JSON score files from ``source``; for every video with an ``is_end`` row append choose(its scores) to ``out``.

    ``choose`` gets video_id, frame_idx, expert, query, score of complete videos. A missing ``is_end`` is false.
    Frames of a video that ended in an earlier batch come too late: they are appended to ``<out>-late`` and
    not selected, and a second end marker is ignored. A batch that is run again after a failure overwrites its own part of all
    tables, so nothing is counted twice.
    """
    ends = f"{table}-ended"

    def batch(rows: DataFrame, number: int) -> None:
        slot = F.pmod(F.xxhash64("video_id"), F.lit(SLOTS)).cast("int")
        rows = rows.withColumn("is_end", F.coalesce("is_end", F.lit(False))).withColumn("slot", slot).persist()
        slots = [r.slot for r in rows.select("slot").distinct().collect()]  # at most SLOTS
        known = spark.read.schema("video_id string, batch long, slot int").parquet(ends).where(F.col("slot").isin(slots) & (F.col("batch") < number)) if _exists(spark, ends) else None
        fresh = rows
        if known is not None:
            late = rows.where("not is_end").join(known.select("video_id").distinct(), "video_id", "left_semi").drop("is_end", "slot")
            late.write.mode("overwrite").parquet(f"{out}-late/batch={number}")
            fresh = rows.join(known.select("video_id").distinct(), "video_id", "left_anti")
        frames = fresh.where("not is_end").drop("is_end").withColumn("batch", F.lit(number).cast("long"))
        _replace(frames, table, number)
        ended = fresh.where("is_end").select("video_id", "slot").distinct().persist()
        if at := [r.slot for r in ended.select("slot").distinct().collect()]:
            complete = spark.read.parquet(table).where(F.col("slot").isin(at) & (F.col("batch") <= number)).drop("batch", "slot")
            choose(complete.join(ended.select("video_id"), "video_id", "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={number}")
            _replace(ended.withColumn("batch", F.lit(number).cast("long")), ends, number)
        ended.unpersist()
        rows.unpersist()

    stream = spark.readStream.schema(SCHEMA).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _replace(rows: DataFrame, table: str, number: int) -> None:
    """Write a batch's rows into the folders of their slots, in place of what an earlier try of the batch wrote."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(table)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
