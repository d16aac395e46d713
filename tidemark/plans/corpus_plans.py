"""Queries on corpus quality and scientometric context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import quarters as Q
from tidemark.functions.numeric import rounded
from tidemark.operators import corpus, graph, metrics
from tidemark.plans import bindings as B
from tidemark.plans.bindings import REFS, WORKS, with_


@query("""
SELECT o_orderkey AS work_id, year(o_orderdate)::INTEGER AS pub_year, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INTEGER AS q_idx,
  year(o_orderdate) || 'Q' || quarter(o_orderdate) AS pub_qtr FROM orders""")
def d001_time_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_orderdate").alias("publication_date"))
    return corpus.add_time_vars(o).drop("publication_date")


@query("SELECT o_orderkey AS work_id, TRY_CAST(o_orderpriority AS INTEGER) AS priority, o_custkey::VARCHAR AS author, NULL::VARCHAR AS doi FROM orders")
def d002_enforced_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Work ID"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("author"))
    return corpus.enforce_schema(corpus.normal_headers(o), {"work_id": "bigint", "priority": "int", "author": "string", "doi": "string"}, ["work_id"])


@query("""
SELECT o_custkey AS author_id, o_orderkey AS work_id, o_totalprice AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""")
def d003_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = corpus.deduplicate(B.table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return o.select(F.col("o_custkey").alias("author_id"), F.col("o_orderkey").alias("work_id"), F.col("o_totalprice").alias("price"))


@query("""
SELECT count(*) AS original, count(*) - count(DISTINCT o_custkey) AS duplicates, count(DISTINCT o_custkey) AS final,
  round(100.0 * (count(*) - count(DISTINCT o_custkey)) / count(*), 4)::DOUBLE AS rate_pct FROM orders""")
def d003_duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_stats(B.table(spark, sf_dir, "orders"), "o_custkey")


@query(with_(WORKS) + """
SELECT 'recent__' || pub_qtr || '_' || kind AS slice_key, count(*) AS rows FROM works WHERE publication_date >= DATE '1999-01-01' GROUP BY 1""")
def d004_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.apply_slice(B.works(spark, sf_dir), "publication_date >= @cutoff", ["pub_qtr", "kind"], "recent", cutoff="1999-01-01")
    return s.groupBy("slice_key").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT round(avg((o_orderpriority = '1-URGENT')::INT), 6) AS share, avg((o_orderpriority = '1-URGENT')::INT) >= 0.3 AS aligned FROM orders")
def d005_topic_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.topic_share(B.works(spark, sf_dir), "topic", "1-URGENT")


@query(with_(WORKS, REFS) + """
SELECT w.pub_qtr, count(*) AS refs_total, count(k.work_id) AS refs_in_corpus, round(count(k.work_id) / count(*)::DOUBLE, 6) AS share
FROM refs r JOIN works w ON r.work_id = w.work_id LEFT JOIN (SELECT work_id FROM works WHERE kind = 'F') k ON r.ref_id = k.work_id GROUP BY 1""")
def d006_reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.works(spark, sf_dir)
    dated = B.refs(spark, sf_dir).join(w.select("work_id", "pub_qtr"), "work_id")
    return corpus.resolve_references(dated, w.where("kind = 'F'"), "pub_qtr")


@query(with_(WORKS) + """
SELECT count(*) AS rows, count(*) FILTER (publication_date < DATE '1996-01-01' OR publication_date > DATE '2000-12-31') AS out_of_window,
  count(*) FILTER (author_id IS NULL) AS null_keys, count(author_id) - count(DISTINCT author_id) AS duplicate_keys, 0::BIGINT AS wrong_ref_counts FROM works""")
def d007_slice_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.validate_slice(B.works(spark, sf_dir), "author_id", "publication_date", F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))


@query(with_(WORKS) + "SELECT pub_year, pub_qtr, count(*) AS rows FROM works GROUP BY ALL")
def d008_time_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.time_periods(B.works(spark, sf_dir))


@query("""
SELECT k.period, (k.y * 4 + k.n - 1)::INTEGER AS q_idx, make_date(k.y, 3 * k.n - 2, 1) AS starts, CAST(make_date(k.y, 3 * k.n - 2, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ends
FROM (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN y || 'Q' || n WHEN 1 THEN 'Q' || n || ' ' || y ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period, y, n
  FROM (SELECT *, year(o_orderdate) AS y, quarter(o_orderdate) AS n FROM orders)) k""")
def f001_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, n = F.year("o_orderdate"), F.quarter("o_orderdate")
    kind = F.col("o_orderkey") % 3
    period = F.when(kind == 0, F.concat(y, F.lit("Q"), n)).when(kind == 1, F.concat(F.lit("Q"), n, F.lit(" "), y)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = B.table(spark, sf_dir, "orders").select(period.alias("period")).distinct().withColumn("q_idx", Q.parse_period(F.col("period")))
    return rows.withColumns({"starts": Q.quarter_start(F.col("q_idx")), "ends": Q.quarter_end(F.col("q_idx"))})


@query(with_(WORKS) + """, pairs AS (SELECT DISTINCT author_id, q_idx FROM works), firsts AS (SELECT author_id, min(q_idx) AS q_idx FROM pairs GROUP BY 1),
joined AS (SELECT q_idx, count(*) AS authors, (SELECT count(*) FROM firsts f WHERE f.q_idx = p.q_idx) AS new_authors FROM pairs p GROUP BY q_idx)
SELECT q_idx, authors, new_authors, authors - new_authors AS returning, round(new_authors / authors::DOUBLE, 6) AS new_rate, (sum(new_authors) OVER (ORDER BY q_idx))::BIGINT AS cumulative FROM joined""")
def d056_author_influx(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.author_influx(B.works(spark, sf_dir))
    return m.withColumn("new_rate", F.round("new_rate", 6))


VELOCITY = with_(WORKS) + """, aged AS (
  SELECT *, greatest((CAST(make_date(pub_year, (q_idx % 4) * 3 + 1, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) - publication_date) / 365.25::DOUBLE, 0) AS age FROM works),
fast AS (SELECT *, cited_by_count / greatest(age, 0.25) AS velocity FROM aged)"""


@query(VELOCITY + """
SELECT q_idx, count(*) AS works, round(avg(velocity), 6) AS mean, round(median(velocity), 6) AS median, round(quantile_cont(velocity, 0.9), 6) AS p90,
  round(avg((velocity >= 300)::INT), 6) AS fast_share, round(avg((age <= 2)::INT), 6) AS young_share FROM fast GROUP BY 1""")
def d057_citation_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.citation_velocity(B.works(spark, sf_dir), fast=300)
    return m.select("q_idx", "works", *rounded(["mean", "median", "p90", "fast_share", "young_share"]))


@query(VELOCITY + """
SELECT q_idx, place, work_id, round(velocity, 6) AS velocity FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY velocity DESC, work_id)::INTEGER AS place FROM fast) WHERE place <= 5""")
def d057_top_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_by_velocity(B.works(spark, sf_dir)).withColumn("velocity", F.round("velocity", 6))


@query(with_(WORKS, REFS) + """, pairs AS (
  SELECT w.q_idx, w.work_id, (w.publication_date - c.publication_date) / 365.25::DOUBLE AS age FROM refs r JOIN works w ON r.work_id = w.work_id JOIN works c ON r.ref_id = c.work_id),
kept AS (SELECT *, 1 / (age + 1) AS score FROM pairs WHERE age >= 0)
SELECT q_idx, count(*) AS references, count(DISTINCT work_id) AS works_with_refs, round(avg(score), 6) AS vitality, round(avg(age), 6) AS mean_age, round(median(age), 6) AS median_age,
  round(avg((age <= 3)::INT), 6) AS young_share, round(avg((age >= 10)::INT), 6) AS old_share, round(COALESCE(sum(score) FILTER (age <= 3), 0) / sum(score), 6) AS share_recent
FROM kept GROUP BY 1""")
def d058_reference_vitality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.reference_vitality(B.works(spark, sf_dir), B.refs(spark, sf_dir))
    return m.select("q_idx", "references", "works_with_refs", *rounded(["vitality", "mean_age", "median_age", "young_share", "old_share", "share_recent"]))


@query(with_(WORKS) + """, counts AS (SELECT q_idx, topic, count(*) AS n FROM works GROUP BY ALL),
shares AS (SELECT q_idx, n / (sum(n) OVER (PARTITION BY q_idx))::DOUBLE AS p, row_number() OVER (PARTITION BY q_idx ORDER BY n DESC, topic) AS place FROM counts),
sums AS (SELECT q_idx, count(*) AS topics, -sum(p * ln(p)) AS shannon, sum(p * p) AS hhi, sum(CASE WHEN place <= 3 THEN p ELSE 0 END) AS top_share FROM shares GROUP BY 1)
SELECT q_idx, topics, round(shannon, 6) AS shannon, round(exp(shannon), 6) AS effective, round(hhi, 6) AS hhi, round(1 - hhi, 6) AS simpson, round(top_share, 6) AS top_share FROM sums""")
def d059_topic_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.topic_diversity(B.works(spark, sf_dir), k=3)
    return m.select("q_idx", "topics", *rounded(["shannon", "effective", "hhi", "simpson", "top_share"]))


BRIDGES = with_(WORKS, REFS) + """, e AS (SELECT DISTINCT least(r.work_id, ref_id) AS a, greatest(r.work_id, ref_id) AS b FROM refs r WHERE r.work_id <> ref_id),
j AS (SELECT a, b, (x.topic <> y.topic)::BIGINT AS cross_ FROM e JOIN works x ON a = x.work_id JOIN works y ON b = y.work_id),
nodes AS (SELECT work_id, count(*) AS degree, sum(cross_)::BIGINT AS external, sum(cross_) / count(*)::DOUBLE AS bridging
  FROM (SELECT a AS work_id, cross_ FROM j UNION ALL SELECT b, cross_ FROM j) GROUP BY 1 HAVING count(*) >= 3)"""


def _bridging(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, r = B.works(spark, sf_dir), B.refs(spark, sf_dir)
    return metrics.bridging_nodes(r.select(F.col("work_id").alias("src"), F.col("ref_id").alias("dst")), w.select("work_id", F.col("topic").alias("community_id")))


@query(BRIDGES + "SELECT work_id, degree, external, round(bridging, 6) AS bridging FROM nodes")
def d060_bridging_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bridging(spark, sf_dir).withColumn("bridging", F.round("bridging", 6))


@query(BRIDGES + """
SELECT count(*) AS nodes, round(avg(bridging), 6) AS mean, round(median(bridging), 6) AS median, round(quantile_cont(bridging, 0.9), 6) AS p90, round(avg((bridging >= 0.5)::INT), 6) AS high_share FROM nodes""")
def d060_bridging_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bridging_summary(_bridging(spark, sf_dir)).select("nodes", *rounded(["mean", "median", "p90", "high_share"]))


@query(with_(WORKS, REFS) + """, k AS (SELECT * FROM works WHERE kind = 'F'),
e AS (SELECT DISTINCT r.work_id, ref_id, greatest(s.q_idx, d.q_idx) AS q FROM refs r JOIN k s ON r.work_id = s.work_id JOIN k d ON ref_id = d.work_id WHERE r.work_id <> ref_id),
n AS (SELECT q_idx, count(*) AS n FROM k GROUP BY 1), m AS (SELECT q AS q_idx, count(*) AS m FROM e GROUP BY 1),
c AS (SELECT q_idx, count(*) AS c FROM (SELECT node, min(q) AS q_idx FROM (SELECT work_id AS node, q FROM e UNION ALL SELECT ref_id, q FROM e) GROUP BY 1) GROUP BY 1),
t AS (SELECT q_idx, sum(COALESCE(n, 0)) OVER w AS n, sum(COALESCE(m, 0)) OVER w AS m, sum(COALESCE(c, 0)) OVER w AS c
  FROM n FULL JOIN m USING (q_idx) FULL JOIN c USING (q_idx) WINDOW w AS (ORDER BY q_idx))
SELECT q_idx, n::BIGINT AS nodes, m::BIGINT AS edges, round(COALESCE(m / nullif(n * (n - 1), 0)::DOUBLE, 0), 9) AS density, round(m / n::DOUBLE, 6) AS avg_degree, round((n - c) / n::DOUBLE, 6) AS isolated_share FROM t""")
def d017_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.works(spark, sf_dir).where("kind = 'F'")
    s = graph.graph_stats_by_quarter(w, graph.citation_edges(w, B.refs(spark, sf_dir)))
    return s.select("q_idx", "nodes", "edges", F.round("density", 9).alias("density"), *rounded(["avg_degree", "isolated_share"]))
