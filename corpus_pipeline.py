"""Five stages from raw documents to token ids: toxicity, lines, near-duplicates, mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again for the next; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesift.llm.bpe import read_ranks, round_trip
from cuesift.llm.lines import dedup_lines
from cuesift.llm.mixing import curriculum
from cuesift.llm.near_dup import near_duplicates
from cuesift.llm.storage import written
from cuesift.llm.toxicity import toxicity

TOXIC_AT = 0.3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC_AT``; labels outside fold 2 of 4 are learnt."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=TOXIC_AT)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each group of like lines kept at its first place only."""
    return dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the smallest doc_id.

    A doc_id goes if none of its rows is kept. Documents without words or without an id stay.
    """
    gone = near_duplicates(docs, k=5, percent=80).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row for each time that a document is taken."""
    return curriculum(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, a row per row."""
    return round_trip(docs, read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express SuperMinHash or the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
