"""One query for each operator, at production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from cuesift.llm.block_search import NEAREST_SQL, nearest_of_twentieth
from cuesift.llm.bpe import read_ranks, round_trip
from cuesift.llm.collocations import COLLOCATIONS_SQL, collocations
from cuesift.llm.labelled import fold
from cuesift.llm.lines import like_lines
from cuesift.llm.matroska import stored_texts
from cuesift.llm.mixing import TAKEN_SQL, taken
from cuesift.llm.near_dup import near_duplicates
from cuesift.llm.periodic import run_digests
from cuesift.llm.quality import quality
from cuesift.llm.shards import training_order
from cuesift.llm.suffix_tree import suffix_tree_scores
from cuesift.llm.toxicity import toxicity
from cuesift.llm.vectors import embedding_groups


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _scored(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity(_documents(spark, sf_dir).select("doc_id", "text"), _labels(spark, sf_dir), threshold=0.3))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return like_lines(_documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality(_documents(spark, sf_dir).select("doc_id", "text"), _labels(spark, sf_dir), threshold=0.7))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(_documents(spark, sf_dir))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(_documents(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return round_trip(_documents(spark, sf_dir), raw, public_tokenizers.PATTERN)


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(_documents(spark, sf_dir))


def op10_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), k=4, percent=80)


def op11_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_of_twentieth(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(_documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mixing": op2_mixing,
        "op3_line_dedup": op3_line_dedup,
        "op4_quality": op4_quality,
        "op5_training_order": op5_training_order,
        "op6_matroska": op6_matroska,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_bpe": op8_bpe,
        "op9_suffix_tree": op9_suffix_tree,
        "op10_super_minhash": op10_super_minhash,
        "op11_block_search": op11_block_search,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": TAKEN_SQL, "op11_block_search": NEAREST_SQL, "op13_collocations": COLLOCATIONS_SQL}
