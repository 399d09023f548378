"""Training-data pipeline over the documents table: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstream.llm import bpe, decontaminate, langid, lines, near
from shopstream.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt from these documents; those without letters, and long ones unlike all of them, go."""
    return langid.keep_recognised(docs, langid.learn(docs.where(~langid.held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents of which nothing is left."""
    return lines.without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return near.first_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document left, with the text that the ids decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN).withColumn("decoded", F.col("decoded").cast("string"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can't express the learnt and the tokenizing stages; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = tables.put(stage(spark, docs, sf_dir), name)
        if k:  # what the stage before wrote is not read again
            tables.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
