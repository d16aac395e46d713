"""Queries on the events table: batch runs of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.plans import bindings as B
from tidemark.streaming import events as S


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY ALL""")
def s001_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.windowed(_events(spark, sf_dir), "1 day")
    return w.select(F.col("starts").cast("timestamp_ntz").alias("starts"), "event_type", "n", F.round("total", 4).alias("total"), "peak")


@query("""SELECT s AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak FROM (
  SELECT *, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS s FROM events) GROUP BY ALL""")
def s002_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.windowed(_events(spark, sf_dir), "1 day", "12 hours")
    return w.select(F.col("starts").cast("timestamp_ntz").alias("starts"), "event_type", "n", F.round("total", 4).alias("total"), "peak")


@query("""SELECT user_id, count(*) AS n, min(ts) AS starts FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours' THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")
def s003_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.sessions(_events(spark, sf_dir), "6 hours")
    return s.select("user_id", "n", F.col("starts").cast("timestamp_ntz").alias("starts"))
