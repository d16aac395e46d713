"""Views of the driver's tables as works, references, series, texts and vectors, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.quarters import quarter_index, quarter_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as works: the customer is the author, the priority the topic."""
    o = table(spark, sf_dir, "orders")
    q = quarter_index(F.col("o_orderdate"))
    return o.select(
        F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("kind"),
        F.to_date("o_orderdate").alias("publication_date"), F.year("o_orderdate").cast("int").alias("pub_year"), q.alias("q_idx"), quarter_label(q).alias("pub_qtr"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("cited_by_count"),
    )


WORKS = """works AS (
  SELECT o_orderkey AS work_id, o_custkey AS author_id, o_orderpriority AS topic, o_orderstatus AS kind, CAST(o_orderdate AS DATE) AS publication_date,
         year(o_orderdate)::INTEGER AS pub_year, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INTEGER AS q_idx,
         year(o_orderdate) || 'Q' || quarter(o_orderdate) AS pub_qtr, floor(o_totalprice / 1000)::BIGINT AS cited_by_count
  FROM orders)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references of works (orders) to works (parts)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("ref_id")).distinct()


REFS = "refs AS (SELECT DISTINCT l_orderkey AS work_id, l_partkey AS ref_id FROM lineitem)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of a supplier in a quarter as new works of a lineage."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("lineage_id"), quarter_index(F.col("l_shipdate")).alias("q_idx"))
    return l.groupBy("lineage_id", "q_idx").agg(F.count(F.lit(1)).alias("new_works"))


SERIES = """series AS (
  SELECT l_suppkey AS lineage_id, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::INTEGER AS q_idx, count(*)::BIGINT AS new_works
  FROM lineitem GROUP BY ALL)"""


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as lineages of their nation as front. A nation's table is small, but its size is left to the optimiser."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("lineage_id"), F.col("n_name").alias("front"))


MAPPING = "mapping AS (SELECT s_suppkey AS lineage_id, n_name AS front FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers of their source as lineage."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("lineage"), "text", "lang")


TEXTS = "texts AS (SELECT doc_id AS paper_id, source AS lineage, text, lang FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


VECTORS = "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as predictions: a probability from the document's length, the quality label as outcome."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    p = (F.col("n_chars") % 997) / F.lit(997.0)
    return d.join(l, "doc_id").select("doc_id", "source", p.alias("probability"), F.col("quality").alias("outcome"))


SCORES = "scores AS (SELECT doc_id, source, (n_chars % 997) / 997.0::DOUBLE AS probability, quality AS outcome FROM documents JOIN labels USING (doc_id))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
