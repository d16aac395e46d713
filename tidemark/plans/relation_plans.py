"""Queries on general relational operators, the SQL surface and checks of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import sqlapi
from tidemark.catalog import query
from tidemark.functions import text as X
from tidemark.functions.numeric import rounded
from tidemark.operators import checks, corpus, relations
from tidemark.plans import bindings as B
from tidemark.plans.bindings import SERIES, TEXTS, WORKS, with_
from tidemark.plans.text_plans import _STOP


@query("""WITH r AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b FROM lineitem),
ca AS (SELECT a, count(*) AS n FROM r GROUP BY 1), cb AS (SELECT b, count(*) AS n FROM r GROUP BY 1),
ra AS (SELECT a, COALESCE(sum(n) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS ar FROM ca),
rb AS (SELECT b, COALESCE(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS br FROM cb)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ar, br), 6) AS spearman FROM r JOIN ra USING (a) JOIN rb USING (b)""")
def a04_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"))
    return relations.correlations(l, "a", "b").select("n", *rounded(["pearson", "spearman"]))


@query("""SELECT COALESCE(o_orderstatus, 'All') AS o_orderstatus, COALESCE(o_orderpriority, 'All') AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def a04_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.crosstab(B.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(with_(WORKS) + "SELECT pub_year, topic, grouping_id(pub_year, topic) AS level, count(*) AS n, sum(cited_by_count)::BIGINT AS total FROM works GROUP BY ROLLUP (pub_year, topic)")
def a04_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.grouping_totals(B.works(spark, sf_dir), ["pub_year", "topic"], "cited_by_count")


@query(with_(WORKS) + "SELECT kind, topic, grouping_id(kind, topic) AS level, count(*) AS n, sum(cited_by_count)::BIGINT AS total FROM works GROUP BY CUBE (kind, topic)")
def a04_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.grouping_totals(B.works(spark, sf_dir), ["kind", "topic"], "cited_by_count", "cube")


@query(with_(SERIES) + """SELECT lineage_id, q_idx, new_works, rank() OVER o::INTEGER AS rank, dense_rank() OVER o::INTEGER AS dense_rank, round(percent_rank() OVER o, 6) AS percent_rank,
  (row_number() OVER (PARTITION BY lineage_id ORDER BY q_idx) - 1)::INTEGER AS place FROM series WINDOW o AS (PARTITION BY q_idx ORDER BY new_works DESC)""".replace("rank() OVER o::INTEGER AS rank", "(rank() OVER o)::INTEGER AS rank").replace("dense_(rank() OVER o)::INTEGER AS rank", "dense_rank() OVER o").replace("dense_rank() OVER o::INTEGER", "(dense_rank() OVER o)::INTEGER"))
def a05_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relations.with_ranks(B.series(spark, sf_dir), ["q_idx"], "new_works")
    return relations.numbered(r, ["lineage_id"], "q_idx").withColumn("percent_rank", F.round("percent_rank", 6)).select("lineage_id", "q_idx", "new_works", "rank", "dense_rank", "percent_rank", "place")


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS packed, n_nationkey::BIGINT AS key, n_name AS name FROM nation""")
def a07_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = relations.packed(B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), ["n_nationkey", "n_name"])
    both = relations.unpacked(n.select(F.col("n_nationkey").alias("id"), "packed"), "n_nationkey long, n_name string")
    return both.select(F.col("id").alias("n_nationkey"), "packed", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))


_WORDS = rf"list_distinct(list_filter(regexp_extract_all(lower(COALESCE(text, '')), '([\p{{L}}\p{{N}}_]+(?:-+[\p{{L}}\p{{N}}_]+)*)'), lambda w: regexp_full_match(w, '[a-z][a-z0-9\-]{{2,}}') AND NOT list_contains({_STOP}, w)))"


@query(with_(TEXTS) + f"SELECT paper_id, array_to_string(list_sort({_WORDS}), ' ') AS words FROM texts")
def a07_title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.texts(spark, sf_dir).select("paper_id", F.array_join(F.array_sort(X.title_words(F.col("text"))), " ").alias("words"))


@query(with_(TEXTS) + rf"SELECT paper_id, md5(array_to_string(list_filter(regexp_split_to_array(COALESCE(text, ''), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, lower(w))), ' ')) AS words_md5 FROM texts")
def a07_spaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.texts(spark, sf_dir).select("paper_id", F.md5(X.spaced_words(F.col("text"))).alias("words_md5"))


@query(with_(TEXTS) + r"""SELECT term, (regexp_full_match(term, '[0-9]+') OR term IN ('et', 'al', 'fig', 'ref', 'vol') OR (regexp_matches(term, '[a-z]') AND regexp_matches(term, '[0-9]') AND term NOT IN ('p53', 'cas9'))) AS junk
FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM texts WHERE text IS NOT NULL)""")
def a07_junk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.texts(spark, sf_dir).where("text IS NOT NULL").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).distinct()
    return t.select("term", X.is_junk(F.col("term")).alias("junk"))


@query(r"""SELECT c_custkey, regexp_replace(lower(trim(' HTTPS://doi.org/10.' || c_nationkey || '/' || c_name || ' ')), '^https?://(dx\.)?doi\.org/', '') AS doi FROM customer""")
def a07_normal_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer")
    written = F.concat(F.lit(" HTTPS://doi.org/10."), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_name"), F.lit(" "))
    return c.select("c_custkey", X.normal_doi(written).alias("doi"))


@query("""SELECT l_orderkey, string_agg(r, ' ' ORDER BY r) AS refs FROM (SELECT DISTINCT l_orderkey, 'W' || l_partkey AS r FROM lineitem) GROUP BY 1""")
def a07_reference_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References written into one cell, as exports have them, and read again."""
    l = B.table(spark, sf_dir, "lineitem")
    address = F.concat(F.lit("'https://works.example/W"), F.col("l_partkey").cast("string"), F.lit("'"))
    cells = l.groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set(address)), ", "), F.lit("]")).alias("cell"))
    return cells.select("l_orderkey", F.array_join(F.array_sort(corpus.reference_list(F.col("cell"))), " ").alias("refs"))


VIEW_SQL = """SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name"""


@query(VIEW_SQL)
def a08_sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlapi.views(spark, sf_dir).sql(VIEW_SQL)


@query("""WITH q AS (SELECT o_orderkey, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INTEGER AS q_idx FROM orders)
SELECT q_idx, (q_idx // 4) || 'Q' || (q_idx % 4 + 1) AS label, count(*) AS n, q_idx + 2 AS two_later FROM q GROUP BY ALL""")
def a08_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlapi.views(spark, sf_dir).sql("""WITH q AS (SELECT o_orderkey, quarter_index(CAST(o_orderdate AS DATE)) AS q_idx FROM orders), c AS (SELECT q_idx, count(*) AS n FROM q GROUP BY q_idx)
    SELECT c.q_idx, quarter_label(c.q_idx) AS label, n, max(x.q_idx) AS two_later FROM c, LATERAL quarters_between(c.q_idx, c.q_idx + 2) AS x GROUP BY ALL""")


@query("""SELECT 'order has a key' AS "check", count(*) AS rows, count(*) FILTER (o_orderkey IS NULL) AS failed, count(*) FILTER (o_orderkey IS NULL) = 0 AS passed FROM orders
UNION ALL SELECT 'price is positive', count(*), count(*) FILTER (NOT COALESCE(o_totalprice > 0, false)), count(*) FILTER (NOT COALESCE(o_totalprice > 0, false)) = 0 FROM orders
UNION ALL SELECT 'price is under 300000', count(*), count(*) FILTER (NOT COALESCE(o_totalprice < 300000, false)), count(*) FILTER (NOT COALESCE(o_totalprice < 300000, false)) = 0 FROM orders
UNION ALL SELECT 'keys are unique', count(*), count(*) - count(DISTINCT o_orderkey), count(*) = count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'references are known', count(*), count(*) FILTER (o_orderkey IS NULL), count(*) FILTER (o_orderkey IS NULL) = 0 FROM lineitem LEFT JOIN orders ON l_partkey = o_orderkey
UNION ALL SELECT 'no quarter is skipped', count(*), count(*) FILTER (n < span), count(*) FILTER (n < span) = 0 FROM (
  SELECT o_orderpriority, count(DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate)) AS n, max(year(o_orderdate) * 4 + quarter(o_orderdate)) - min(year(o_orderdate) * 4 + quarter(o_orderdate)) + 1 AS span FROM orders GROUP BY 1)""")
def d120_stage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "lineitem")
    rows = checks.check_rows(o, {"order has a key": F.col("o_orderkey").isNotNull(), "price is positive": F.col("o_totalprice") > 0, "price is under 300000": F.col("o_totalprice") < 300000})
    rows = rows.union(checks.check_unique(o, ["o_orderkey"], "keys are unique")).union(checks.check_known(l, "l_partkey", o, "o_orderkey", "references are known"))
    return rows.union(checks.check_steps(B.works(spark, sf_dir), ["topic"], "q_idx", "no quarter is skipped"))
