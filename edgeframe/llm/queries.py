"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_extract, langid, line_dedup, media, mixing, packing, periods, pq, quality, simhash, syncmers, topk
from .common import table


#: Passages of over this many words that repeat are cut even where they fill fewer than three lines.
LONG_LINE_WORDS = 50


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), long_line_words=LONG_LINE_WORDS)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is a document's host; its language stands for the path below it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, F.col("source"), F.col("lang"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_pairs(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)", {"text": chat.PLANTED})
    return chat.digest(rows.union(planted))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.compress(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_line_dedup, op2_html_extraction, op3_best_fit_packing, op4_quality_classifier, op5_simhash,
        op6_language_id, op7_media_columns, op8_document_fingerprints, op9_chat_formatting, op10_mixing,
        op11_vector_codes, op12_periodic_runs, op13_exact_top_k,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE, "op9_chat_formatting": chat.ORACLE, "op10_mixing": mixing.ORACLE,
        "op11_vector_codes": pq.ORACLE, "op13_exact_top_k": topk.ORACLE,
    }
