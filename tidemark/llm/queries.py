"""The opN queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import gif_media, line_dedup, mixing, ngram_join, resampling, sentencepiece_scan, token_counts, token_orc, toxicity, vptree
from tidemark.llm.shared import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op2_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents", "doc_id", "text"), width=4, similarity=(85, 100))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_orc_roundtrip(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_scan.pieces_digest(sentencepiece_scan.encode_pieces(_table(spark, sf_dir, "documents", "doc_id", "text"), model), model)


def op8_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest_inner_products(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.text_media_roundtrip(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels", "doc_id", "quality").where(F.col("quality") == 1)
    return resampling.resample(_table(spark, sf_dir, "documents", "doc_id", "text"), good)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_ngram_components, op3_toxicity, op4_source_mix, op5_line_dedup, op6_token_orc, op7_sentencepiece, op8_vector_neighbours, op9_gif_media, op10_quality_resampling)
}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_components": ngram_join.ORACLE_SQL, "op4_source_mix": mixing.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op8_vector_neighbours": vptree.ORACLE_SQL,
}
