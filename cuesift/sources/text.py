"""Subtitles and question files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesift.functions.text import clock, seconds_of, strip

QA_SCHEMA = (
    "question_id string, video_id string, video_path string, question string, candidates array<string>, answer string, answer_letter string, "
    "answer_index int, subtitle_path string, metadata struct<task_type string, domain string, sub_category string, duration string>"
)
_STAMP = r"(\d+:\d+:\d+[,.]\d+)"


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """SRT files -> video_id (the file's name), seg_idx, start, end, text."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("video_id"), F.col("value").alias("srt"))
    return parse_srt(files)


def parse_srt(files: DataFrame) -> DataFrame:
    """(video_id, srt) -> segments: cues part at blank lines; tags go; cues without a time or text are dropped."""
    whole = F.regexp_replace(F.regexp_replace("srt", "^﻿", ""), r"\r\n?", "\n")
    blocks = files.select("video_id", F.posexplode(F.split(strip(whole), r"\n\s*\n")).alias("_block", "_text"))
    times = blocks.select("video_id", "_block", *[F.regexp_extract("_text", rf"{_STAMP}\s*-->\s*{_STAMP}", i).alias(n) for i, n in ((1, "_from"), (2, "_to"))], F.regexp_extract("_text", r"(?s)-->[^\n]*\n(.*)$", 1).alias("_body"))
    text = strip(F.regexp_replace(F.array_join(F.transform(F.split("_body", "\n"), lambda x: strip(x)), " "), r"<[^>]+>", ""))
    rows = times.where("_from != ''").select("video_id", "_block", seconds_of(F.col("_from")).alias("start"), seconds_of(F.col("_to")).alias("end"), text.alias("text"))
    return rows.where("text != ''").select("video_id", F.col("_block").alias("seg_idx"), "start", "end", "text")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files in JSON, one object each."""
    return spark.read.schema(QA_SCHEMA).json(path, multiLine=True)


def subtitle_prompt(segments: DataFrame) -> DataFrame:
    """(video_id, start, end, text) -> (video_id, prompt): a line '[HH:MM:SS] text' per segment, in order of time."""
    line = F.struct("start", "seg_idx", F.concat(clock(F.col("start")), F.lit(" "), F.col("text")).alias("line"))
    return segments.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("prompt"))


def accuracy(answers: DataFrame) -> DataFrame:
    """(answer, answer_letter) -> correct, total, accuracy; an answer is right if it has the letter in it."""
    right = F.contains(F.col("answer"), F.col("answer_letter")).cast("long")
    return answers.agg(F.sum(right).alias("correct"), F.count("*").alias("total"), F.avg(right).alias("accuracy"))


def selection_prompt(selected: DataFrame, segments: DataFrame, questions: DataFrame) -> DataFrame:
    """One prompt per video and question: frame times in order, subtitles, the question and lettered options.

    ``selected`` (video_id, qid, ts), ``segments`` as in ``subtitle_prompt``, ``questions`` (qid, question, candidates).
    """
    times = selected.groupBy("video_id", "qid").agg(F.array_join(F.transform(F.array_sort(F.collect_set("ts")), lambda t: clock(t)), " ").alias("_times"))
    letters = F.transform("candidates", lambda c, i: F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + 1, F.lit(1)), F.lit(". "), c))
    asked = questions.select("qid", "question", F.coalesce(F.array_join(letters, "\n"), F.lit("")).alias("_options"))
    rows = times.join(asked, "qid").join(subtitle_prompt(segments).withColumnRenamed("prompt", "_subtitles"), "video_id", "left")
    parts = (F.concat(F.lit("Frames at: "), "_times"), F.concat(F.lit("Subtitles:\n"), F.col("_subtitles")), F.concat(F.lit("Question: "), "question"), F.when(F.col("_options") != "", F.concat(F.lit("Options:\n"), "_options")))
    return rows.select("video_id", "qid", F.concat_ws("\n\n", *parts).alias("prompt"))


def encoded_frames(frames: DataFrame) -> DataFrame:
    """(…, image binary) with the image as base64 text, for models that take pictures inline."""
    return frames.withColumn("image", F.base64("image"))
