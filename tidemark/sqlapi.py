"""The SQL surface: tables of a folder as views and the quarter functions, in a session of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Functions in SQL itself, so that the optimiser sees through them.
FUNCTIONS = {
    "quarter_index(d DATE) RETURNS INT": "RETURN year(d) * 4 + quarter(d) - 1",
    "quarter_label(q INT) RETURNS STRING": "RETURN concat(CAST(floor(q / 4) AS STRING), 'Q', CAST(pmod(q, 4) + 1 AS STRING))",
    "safe_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "RETURN coalesce(try_divide(a, b), 0D)",
    "quarters_between(low INT, high INT) RETURNS TABLE (q_idx INT)": "RETURN SELECT explode(sequence(low, high)) AS q_idx",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def views(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> SparkSession:
    """A new session on the same cluster whose temporary views are the Parquet tables of a folder and whose functions are FUNCTIONS; the caller's own catalogue stays as it is."""
    own = spark.newSession()
    for t in tables:
        own.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for head, body in FUNCTIONS.items():
        own.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body}")
    return own
