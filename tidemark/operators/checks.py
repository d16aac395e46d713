"""Checks of stages, freshness of artefacts and provenance, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, rows, failed, passed): rows for which a condition is false or null, all conditions in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"failed_{i}") for i, c in enumerate(checks.values())])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"failed_{i}").alias("failed")) for i, n in enumerate(checks)]))
    return counts.select("rows", each.alias("c")).select("c.check", "rows", "c.failed", (F.col("c.failed") == 0).alias("passed"))


def check_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The same of one check: rows beyond the first of their keys."""
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failed"))
    return sums.select(F.lit(name).alias("check"), "rows", "failed", (F.col("failed") == 0).alias("passed"))


def check_known(df: DataFrame, column: str, known: DataFrame, known_column: str, name: str) -> DataFrame:
    """The same of one check: rows whose value is not null and not among the known ones."""
    ids = known.select(F.col(known_column).alias("known_")).distinct()
    joined = df.join(ids, F.col(column) == F.col("known_"), "left")
    failed = F.count_if(F.col(column).isNotNull() & F.col("known_").isNull())
    return joined.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("rows"), failed.alias("failed")).select("check", "rows", "failed", (F.col("failed") == 0).alias("passed"))


def check_steps(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The same of one check: groups whose order column skips a number between its first and last."""
    spans = df.groupBy(*keys).agg(F.countDistinct(order).alias("n"), (F.max(order) - F.min(order) + 1).alias("span"))
    return spans.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") < F.col("span")).alias("failed")).select("check", "rows", "failed", (F.col("failed") == 0).alias("passed"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, bytes) of the data files below a path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the data files below a path, each read by one task; files whose own checksum fails give no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)
    return found.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def stale(spark: SparkSession, output: str, inputs: list[str]) -> list[str]:
    """Inputs that were modified after the output's oldest file was written."""
    written = files(spark, output).agg(F.min("modified")).first()[0]
    if written is None:
        raise ValueError(f"nothing at {output}")
    return [i for i in inputs if (changed := files(spark, i).agg(F.max("modified")).first()[0]) is not None and changed > written]


def require_fresh(spark: SparkSession, output: str, inputs: list[str]) -> None:
    """Raises if an input is newer than the output."""
    if old := stale(spark, output, inputs):
        raise RuntimeError(f"{output} is older than {', '.join(old)}")


def provenance(spark: SparkSession, inputs: list[str], settings: dict[str, object]) -> dict:
    """What a run read and how it was set: one digest for each input, over the digests of its files in order of their names."""
    found = {}
    for i in inputs:
        rows = digests(spark, i).select(F.regexp_extract("file", r"[^/]+$", 0).alias("name"), "sha256").orderBy("name", "sha256")
        joined = rows.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.concat_ws(":", "name", "sha256")))), 256)).first()[0]
        found[i] = joined
    return {"inputs": found, "settings": {k: settings[k] for k in sorted(settings)}, "spark": spark.version}
