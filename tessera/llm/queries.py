"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fingerprint, html, quality, tiff, toxicity
from tessera.llm.bpe import bpe_encode
from tessera.llm.chat import format_chat
from tessera.llm.common import crc32_mod, documents
from tessera.llm.lines import dedup_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import packed_documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=3, percent=85)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.select("conv_id", "position", "turn", "role", "message", "n_calls", "n_invalid")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe_encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, decode=True)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(crc32_mod(F.col("doc_id"), 4) != 2))
    return toxicity.score(docs, model).select(
        "doc_id",
        (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(crc32_mod(F.col("doc_id"), 5) != 0))
    return quality.score(docs, model).select(
        "doc_id",
        (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "passages",
        "best_passage",
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(documents(spark, sf_dir))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_texts(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_media_columns": op8_media_columns,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE: dict[str, str] = {
    # conversations hold no calls, so a message is its content and role
    "op3_chat_formatting": """
        SELECT conv_id,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position,
               turn, role,
               concat('{"content":', to_json(text), ',"role":', to_json(role), '}') AS message,
               CAST(0 AS INTEGER) AS n_calls, CAST(0 AS INTEGER) AS n_invalid
        FROM conversations""",
}
