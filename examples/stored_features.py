"""Extract transcripts once, keep them, and ask several questions of the store."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesift.pipeline import FrameSelector, Question
from cuesift.plans.tree import Node
from cuesift.sources.features import FeatureStore


def transcribe(videos: DataFrame) -> DataFrame:
    """A stand-in for a speech model: says the path in the first second."""
    return videos.select("video_id", F.lit(0).alias("seg_idx"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.col("path").alias("text"))


def main() -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    videos = spark.createDataFrame([("a", "/cooking.mp4"), ("b", "/cycling.mp4")], "video_id string, path string")
    store = FeatureStore(spark, "file://" + tempfile.mkdtemp())
    store.extract_features(videos, 1.0, {"asr": transcribe}).show()
    grid = videos.select("video_id").withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(9))))
    questions = [Question(q, Node.leaf("ASR", q)) for q in ("cooking", "cycling")]
    FrameSelector().select(grid, questions, {"ASR": {"segments": store.load("asr", videos, 1.0)}}, k=3).orderBy("video_id", "qid", "rank").show()


if __name__ == "__main__":
    main()
