"""The queries of this subpackage over the driver's tables, and the DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import (
    bpe,
    embedding_dedup,
    fill_middle,
    html_text,
    jaccard_join,
    licences,
    mixing,
    quality_net,
    quality_rules,
    secrets,
    token_align,
    token_files,
    url_rules,
)
from tablegauge.session import ship_package


#: Rows and bytes of an Arrow batch, whichever comes first. A longer text is a batch of its own.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
#: Bytes of a batch in the stages of the pipeline that neither gain nor change with larger ones.
SMALL_BATCH = 1 << 20
#: Rows that a reader of Parquet files lays out at once; its arrays hold the whole texts of as many.
READER_ROWS = 512


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Ships this package, and lets Python workers and the JVM hold fewer whole texts at once."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_classes(table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_net.quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    names = {"_tokens": "tokens", "_source": "source_group", "_lang": "lang_group", "_topic": "topic", "_p": "probability", "_kept": "kept"}
    return mixed.select("doc_id", *(F.col(k).alias(v) for k, v in names.items()))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(table(spark, sf_dir, "documents"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.token_links(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_labels(licences.find_licences(table(spark, sf_dir, "documents")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.col("output"), "restored_sha256": fill_middle.restore(F.col("form"), F.col("output"))}
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(F.sha2(v, 256).alias(k) for k, v in digests.items()))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_dedup, op2_token_files, op3_quality_net, op4_url_rules, op5_html_text, op6_bpe, op7_mixing, op8_secrets, op9_jaccard_join,
              op10_quality_rules, op11_token_align, op12_licences, op13_fill_middle, pipeline)
}

ORACLES: dict[str, str] = {"op1_embedding_dedup": embedding_dedup.oracle(), "op9_jaccard_join": jaccard_join.oracle(), "op4_url_rules": url_rules.oracle(), "op7_mixing": mixing.oracle(), "op10_quality_rules": quality_rules.oracle(),
                           "op13_fill_middle": fill_middle.oracle()}
