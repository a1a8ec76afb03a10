"""A corpus pipeline of five operators: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import bpe, jaccard_join, mixing, quality_net, secrets
from tablegauge.llm.queries import SMALL_BATCH, prepare, table, vocabulary
from tablegauge.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network takes for label 1; it learns from the labelled rows that are not held out."""
    prepare(spark)
    return quality_net.quality_scores(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    prepare(spark, SMALL_BATCH)
    return jaccard_join.keep_one_per_class(docs).select(*COLUMNS)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    prepare(spark, SMALL_BATCH)
    return secrets.redact_secrets(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their shares of all words."""
    return mixing.mix_sources(docs).filter("_kept").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with their number and checksums."""
    prepare(spark, SMALL_BATCH)
    encoded = bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=True)
    return encoded.select("doc_id", F.col("ids").alias("token_ids"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("near_copies", near_copies), ("redaction", redaction), ("mixture", mixture), ("encoding", encoding)]

#: No SQL says what a trained network decides; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
