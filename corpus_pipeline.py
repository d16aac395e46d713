"""A training-corpus pipeline: STAGES in order, each over all that its predecessor kept.

Every stage but the last returns the columns of documents. Documents with null or empty texts pass: they hold nothing to
reject, repeat, link or mix.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, ngram_join, sentencepiece_scan, toxicity
from tidemark.llm.shared import bounded_batches, materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; it is fitted on the labelled ones among docs."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go, and with them documents that had nothing else; n_chars follows the text."""
    bounded_batches(spark)
    kept = line_dedup.dedup_lines(docs).where("n_dropped = 0 OR n_dropped < n_lines")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of least id stays."""
    bounded_batches(spark)
    return ngram_join.without_near_copies(docs, width=5, similarity=(80, 100))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, ids, n_pieces and whether decoding the ids gives the text."""
    bounded_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_scan.encode_pieces(docs, model, restore=True)
    return encoded.select("doc_id", "text", "ids", F.size("ids").cast("long").alias("n_pieces"), "restored")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("source_mix", mix_to_weights),
    ("sentencepiece", encode),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
