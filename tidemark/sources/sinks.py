"""Sinks: partitioned tables, raw chunks, metric tables with a manifest that can be verified."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import checks
from tidemark.sources import files

#: Schemas of metric tables by level.
METRIC_SCHEMAS = {"global": "quarter string, value double", "front": "front_id string, quarter string, value double", "lineage": "lineage_id bigint, quarter string, value double"}


def write_slices(df: DataFrame, path: str, by: str = "pub_qtr") -> None:
    """One folder for each value of the slice column, so that readers prune.

    Rows of a slice are brought together first, by rebalancing: a slice of very many rows is split over several tasks and files.
    """
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def slice_stats(spark: SparkSession, path: str, by: str = "pub_qtr") -> DataFrame:
    """Rows, files and bytes of each slice, as written: row counts come from the files' footers."""
    rows = spark.read.parquet(path).groupBy(by, F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes"))
    return rows.groupBy(by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def write_raw(df: DataFrame, path: str, chunk: int = 1000) -> None:
    """Gzipped NDJSON in files of at most `chunk` records."""
    df.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", chunk).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, edges sorted by the quarter from which they hold, so that cumulative graphs skip row groups."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.sortWithinPartitions("valid_from_q").write.mode("overwrite").parquet(f"{path}/edges")


def write_metric(df: DataFrame, path: str, level: str) -> None:
    """A metric table of one of the fixed schemas; other columns or types raise."""
    if level not in METRIC_SCHEMAS:
        raise ValueError(f"unknown level: {level!r}")
    empty = df.sparkSession.createDataFrame([], METRIC_SCHEMAS[level])
    df.to(empty.schema).write.mode("overwrite").parquet(path)


def file_digests(folder: str, spark: SparkSession | None = None) -> dict[str, str]:
    """SHA-256 of each data file of a folder, by its name below the folder; files are hashed where they are read, one row each comes back."""
    spark = spark or SparkSession.getActiveSession()
    root = re.sub(r"^file:/*", "/", folder).rstrip("/") + "/"
    rows = checks.digests(spark, folder).collect()
    return {re.sub(r"^file:/*", "/", r["file"]).removeprefix(root): r["sha256"] for r in rows}


def write_manifest(folder: str, details: dict, spark: SparkSession | None = None) -> str:
    """manifest.json beside a folder with its digests and details; written whole or not at all."""
    spark = spark or SparkSession.getActiveSession()
    path = f"{folder.rstrip('/')}.manifest.json"
    files.write_text(spark, path, json.dumps({"files": file_digests(folder, spark), **details}, indent=1, sort_keys=True))
    return path


def verify_manifest(folder: str, spark: SparkSession | None = None) -> list[str]:
    """Files that are missing, new or changed since the manifest was written."""
    spark = spark or SparkSession.getActiveSession()
    then = json.loads(files.read_text(spark, f"{folder.rstrip('/')}.manifest.json"))["files"]
    now = file_digests(folder, spark)
    return sorted(k for k in then.keys() | now.keys() if then.get(k) != now.get(k))


def snapshot(df: DataFrame, folder: str, details: dict) -> str:
    """A dated copy of a table that is never overwritten, with its manifest: what an archive keeps."""
    df.write.mode("errorifexists").parquet(folder)
    return write_manifest(folder, details, df.sparkSession)


def write_results(df: DataFrame, path: str, kind: str = "csv", order: list[str] | None = None) -> None:
    """A result table as one CSV (with a header) or NDJSON file; for tables of report size."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown result kind: {kind!r}")
    one = (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite")
    one.option("header", "true").csv(path) if kind == "csv" else one.json(path)


def audit_events(spark: SparkSession, path: str, kind: str | None = None, status: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of an NDJSON audit log (ts, kind, status, message), newest first."""
    log = spark.read.schema("ts timestamp, kind string, status string, message string").json(path)
    for column, value in (("kind", kind), ("status", status)):
        log = log.where(log[column] == value) if value else log
    log = log.where(log["ts"] >= since) if since else log
    log = log.orderBy(log["ts"].desc(), "kind", "message")
    return log.limit(limit) if limit else log
