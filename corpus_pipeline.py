"""The corpus pipeline: documents are judged, deduplicated, mixed and tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again for
the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup, mix, near_copies, pieces, quality
from tidegauge.plans.scratch import Scratch, released

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from all labelled documents but the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    model = quality.train(docs, labels)
    return quality.score(docs, model, to="__score").where(F.col("__score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity of 0.8 or more over shingles of five words."""
    return near_copies.keep(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt over its shards and shuffled within each."""
    return mix.shuffled(mix.mix(spark, docs)).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the number of them."""
    return pieces.encode(docs.select("doc_id", "source", "text")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality classifier", judge), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("source mix", mix_sources), ("sentencepiece", tokenise)]

#: Neither the classifier nor the tokenizer can be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with released():  # a stage's own tables go once its result is written
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
