"""Select frames of all videos for a question with options, from stored vectors and transcripts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cuesift.pipeline import FrameSelector
from cuesift.plans.parsing import create_parser
from cuesift.plans.tree import explain

DATA = "/root/testdata/sf0.01"


def main() -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    talks = spark.read.parquet(f"{DATA}/conversations.parquet")
    segments = talks.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_idx"), (F.col("turn") * 3.0).alias("start"), (F.col("turn") * 3.0 + 3).alias("end"), "text")
    frames = segments.groupBy("video_id").agg(F.max("end").cast("int").alias("n")).withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.col("n"))))
    selector = FrameSelector.preset("default", parser=create_parser("rule"))
    question = selector.parse("q1", 'Someone says "thing" then someone says "order"?', ["yes", "no"])
    print(explain(question.tree))
    selector.select(frames, [question], {"ASR": {"segments": segments}}, k=8).orderBy("video_id", "rank").show(16)


if __name__ == "__main__":
    main()
