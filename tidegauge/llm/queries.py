"""The queries of this subpackage, op1_ to op13_, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, exact_dedup, lattice, licences, mix, pieces, quality, rules, simhash, token_files, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(n: int):
    """Of a row's id; null ids count as the empty text, so that every row is in a fold."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(spark, _read(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken(spark, _read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, _read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _read(spark, sf_dir, "labels").where(_remainder(4) != 2))
    scored = quality.score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(spark, docs, _read(spark, sf_dir, "labels").where(_remainder(5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size(F.filter("passages", lambda p: p["chance"] <= toxicity.SIGNIFICANT)).cast("long").alias("n_passages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(spark, _read(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, _read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.counted(spark, _read(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(spark, _read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = conversations.given(_read(spark, sf_dir, "conversations"))
    return conversations.digests(spark, conversations.damaged(talks), talks)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_mix_sources, op4_simhash, op5_quality, op6_toxicity, op7_embedding_dedup, op8_license_scan, op9_exact_dedup, op10_token_files, op11_alignment, op12_quality_rules, op13_conversation_repair)}

ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op3_mix_sources": mix.ORACLE,
    "op8_license_scan": licences.ORACLE,
    "op12_quality_rules": rules.ORACLE,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
