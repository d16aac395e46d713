"""Queries on graphs, communities and lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions.numeric import rounded
from tidemark.operators import communities as C
from tidemark.operators import convergence, graph
from tidemark.plans import bindings as B
from tidemark.plans.bindings import REFS, SERIES, WORKS, with_

CORPUS = with_(WORKS, REFS) + ", k AS (SELECT * FROM works WHERE kind = 'F')"
EDGES = CORPUS + """, edges AS (SELECT DISTINCT r.work_id AS src, ref_id AS dst, greatest(s.q_idx, d.q_idx) AS valid_from_q
  FROM refs r JOIN k s ON r.work_id = s.work_id JOIN k d ON ref_id = d.work_id WHERE r.work_id <> ref_id)"""


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.works(spark, sf_dir).where("kind = 'F'")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.citation_edges(_corpus(spark, sf_dir), B.refs(spark, sf_dir))


@query(EDGES + "SELECT * FROM edges")
def d009_citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


COUPLING = with_(WORKS, REFS) + """, s AS (SELECT work_id, count(*) AS n FROM refs GROUP BY 1),
sh AS (SELECT a.work_id AS node_a, b.work_id AS node_b, count(*) AS shared_refs FROM refs a JOIN refs b ON a.ref_id = b.ref_id AND a.work_id < b.work_id GROUP BY ALL HAVING count(*) >= 2),
sc AS (SELECT sh.*, x.n AS ref_count_a, y.n AS ref_count_b, shared_refs / sqrt(x.n::DOUBLE * y.n) AS coupling_score FROM sh JOIN s x ON node_a = x.work_id JOIN s y ON node_b = y.work_id WHERE shared_refs / sqrt(x.n::DOUBLE * y.n) >= 0.25),
wt AS (SELECT sc.*, COALESCE(abs(p.pub_year - q.pub_year), 0) AS years_apart, 0.3 * coupling_score * exp(-0.15 * COALESCE(abs(p.pub_year - q.pub_year), 0)) AS weight_coupling
  FROM sc LEFT JOIN works p ON node_a = p.work_id LEFT JOIN works q ON node_b = q.work_id WHERE COALESCE(abs(p.pub_year - q.pub_year), 0) <= 5)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coupling_scores(B.refs(spark, sf_dir), min_shared=2)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coupling_weights(_scores(spark, sf_dir), B.works(spark, sf_dir))


@query(COUPLING + "SELECT node_a, node_b, shared_refs FROM sh")
def d010_shared_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_references(B.refs(spark, sf_dir), 2)


@query(COUPLING + "SELECT node_a, node_b, shared_refs, ref_count_a, ref_count_b, round(coupling_score, 6) AS coupling_score FROM sc")
def d011_coupling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("node_a", "node_b", "shared_refs", "ref_count_a", "ref_count_b", F.round("coupling_score", 6).alias("coupling_score"))


HYBRID = COUPLING + """, cit AS (SELECT DISTINCT work_id AS src, ref_id AS dst FROM refs WHERE work_id <> ref_id AND ref_id IN (SELECT work_id FROM works)),
bo AS (SELECT node_a AS src, node_b AS dst, weight_coupling AS w FROM wt UNION ALL SELECT node_b, node_a, weight_coupling FROM wt),
hy AS (SELECT COALESCE(c.src, b.src) AS src, COALESCE(c.dst, b.dst) AS dst, CASE WHEN c.src IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS weight_citation, COALESCE(w, 0) AS weight_coupling,
  CASE WHEN w IS NULL THEN 'citation' WHEN c.src IS NULL THEN 'coupling' ELSE 'hybrid' END AS edge_type FROM cit c FULL JOIN bo b ON c.src = b.src AND c.dst = b.dst)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.works(spark, sf_dir)
    return graph.hybrid_edges(graph.citation_edges(w, B.refs(spark, sf_dir)), _weights(spark, sf_dir))


@query(HYBRID + "SELECT src, dst, weight_citation, round(weight_coupling, 6) AS weight_coupling, round(weight_citation + weight_coupling, 6) AS weight_total, edge_type FROM hy")
def d012_hybrid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("src", "dst", "weight_citation", *rounded(["weight_coupling", "weight_total"]), "edge_type")


@query(HYBRID + """SELECT edge_type, count(*) AS edges, round(sum(weight_citation + weight_coupling), 4) AS weight_sum, round(avg(weight_citation + weight_coupling), 6) AS weight_mean,
  round(min(weight_citation + weight_coupling), 6) AS weight_min, round(max(weight_citation + weight_coupling), 6) AS weight_max FROM hy GROUP BY 1""")
def d013_edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_stats(_hybrid(spark, sf_dir)).select("edge_type", "edges", F.round("weight_sum", 4).alias("weight_sum"), *rounded(["weight_mean", "weight_min", "weight_max"]))


@query(COUPLING + """, g AS (SELECT b::DOUBLE AS beta, d::DOUBLE AS decay, years_apart, b * coupling_score * exp(-d * years_apart) AS w FROM wt, (SELECT unnest([0.3::DOUBLE, 0.5]) AS b), (SELECT unnest([0.1::DOUBLE, 0.2]) AS d))
SELECT beta, decay, count(*) AS pairs, round(sum(w), 4) AS w_sum, round(avg(w), 6) AS w_mean, round(stddev_pop(w), 6) AS w_std, round(min(w), 6) AS w_min, round(max(w), 6) AS w_max, round(quantile_cont(w, 0.95), 6) AS w_p95,
  median(years_apart)::DOUBLE AS median_years FROM g GROUP BY ALL""")
def d014_coupling_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.coupling_sensitivity(_scores(spark, sf_dir), B.works(spark, sf_dir), [0.3, 0.5], [0.1, 0.2])
    return s.select("beta", "decay", "pairs", F.round("w_sum", 4).alias("w_sum"), *rounded(["w_mean", "w_std", "w_min", "w_max", "w_p95"]), "median_years")


@query(CORPUS + """SELECT 'cumulative' AS scope, count(*) AS nodes FROM k WHERE q_idx <= 7990 UNION ALL SELECT 'delta', count(*) FROM k WHERE q_idx = 7990 UNION ALL SELECT 'annual', count(*) FROM k WHERE q_idx // 4 <= 7990 // 4""")
def d015_scoped_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for scope in ("cumulative", "delta", "annual"):
        one = graph.nodes_at(_corpus(spark, sf_dir), 7990, scope).agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(scope).alias("scope"), "nodes")
        out = one if out is None else out.unionByName(one)
    return out


@query(EDGES + """, d AS (SELECT dst, count(*) AS n FROM edges WHERE valid_from_q <= 7995 GROUP BY 1)
SELECT work_id, q_idx FROM k LEFT JOIN d ON work_id = dst WHERE q_idx <= 7995 AND q_idx > 7995 - 12 AND NOT (7995 - q_idx > 8 AND COALESCE(n, 0) <= 1)""")
def d016_window_and_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.window_and_prune(_corpus(spark, sf_dir), _edges(spark, sf_dir), 7995, 12, 2, 1).select("work_id", "q_idx")


@query(EDGES + """, n AS (SELECT q_idx, (sum(c) OVER (ORDER BY q_idx))::DOUBLE AS n FROM (SELECT q_idx, count(*) AS c FROM k GROUP BY 1)),
m AS (SELECT n.q_idx, n, (SELECT count(*) FROM edges e WHERE e.valid_from_q <= n.q_idx) AS m FROM n)
SELECT min(q_idx) FILTER (COALESCE(m / nullif(n * (n - 1), 0), 0) >= 0.0001) AS density_from_q, min(q_idx) FILTER (m / n >= 0.5) AS degree_from_q FROM m""")
def d128_regime_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.regime_start(graph.graph_stats_by_quarter(_corpus(spark, sf_dir), _edges(spark, sf_dir)), 0.0001, 0.5)


PART = with_(WORKS) + """, part AS (SELECT q.q_idx, w.work_id, ((w.author_id + CASE WHEN w.work_id % 10 = q.q_idx % 10 THEN 1 ELSE 0 END) % 12)::BIGINT AS community_id
  FROM works w JOIN (SELECT unnest(range(7990, 7996))::INTEGER AS q_idx) q ON w.q_idx <= q.q_idx)"""


#: The quarters of the SQL twins. The queries named _all take every quarter of the data.
TWIN_QUARTERS = [*range(7990, 7996)]


def _quarters(spark: SparkSession, sf_dir: str) -> list[int]:
    """All quarters of the works: a few dozen numbers by nature."""
    return [r.q_idx for r in B.works(spark, sf_dir).where("q_idx IS NOT NULL").select("q_idx").distinct().orderBy("q_idx").collect()]


def _over_all_quarters(f) -> None:
    """Registers f over every quarter of the data, as f's name and _all."""

    def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, _quarters(spark, sf_dir))

    whole.__name__ = f"{f.__name__}_all"
    query()(whole)


def _partition(spark: SparkSession, sf_dir: str, quarters: list[int]) -> DataFrame:
    """A deterministic partition of the works of each of the quarters, in which some works move."""
    w = B.works(spark, sf_dir)
    at = F.explode(F.filter(F.array(*[F.lit(q) for q in quarters]).cast("array<int>"), lambda q: q >= F.col("w_q")))
    rows = w.select("work_id", "author_id", F.col("q_idx").alias("w_q")).withColumn("q_idx", at)
    moved = F.when(F.col("work_id") % 10 == F.col("q_idx") % 10, 1).otherwise(0)
    return rows.select("q_idx", "work_id", ((F.col("author_id") + moved) % 12).cast("long").alias("community_id"))


@query(PART + """, a AS (SELECT (q_idx + 1)::INTEGER AS q_idx, work_id, community_id AS x FROM part WHERE q_idx < 7995), b AS (SELECT q_idx, work_id, community_id AS y FROM part WHERE q_idx > 7990),
j AS (SELECT COALESCE(a.q_idx, b.q_idx) AS q_idx, COALESCE('a' || x, 'only' || b.work_id) AS x, COALESCE('b' || y, 'only' || a.work_id) AS y FROM a FULL JOIN b ON a.q_idx = b.q_idx AND a.work_id = b.work_id),
c AS (SELECT q_idx, x, y, count(*) AS n FROM j GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY q_idx) AS total, sum(n) OVER (PARTITION BY q_idx, x) AS nx, sum(n) OVER (PARTITION BY q_idx, y) AS ny FROM c),
v AS (SELECT q_idx, greatest(-sum(n / total::DOUBLE * (log2(n / nx::DOUBLE) + log2(n / ny::DOUBLE))), 0) AS vi, max(total)::BIGINT AS n_nodes FROM t GROUP BY 1)
SELECT q_idx, round(vi, 6) AS vi, n_nodes, round(CASE WHEN n_nodes > 1 THEN vi / log2(n_nodes) ELSE 0 END, 6) AS nvi FROM v""")
def d028_variation_of_information(spark: SparkSession, sf_dir: str, quarters: list[int] = TWIN_QUARTERS) -> DataFrame:
    p = _partition(spark, sf_dir, quarters)
    before = p.withColumn("q_idx", F.col("q_idx") + 1).where(F.col("q_idx").isin(quarters))
    return C.variation_of_information(before, p.where((F.col("q_idx") - 1).isin(quarters)), ["q_idx"]).select("q_idx", "n_nodes", *rounded(["vi", "nvi"]))


OVERLAPS = PART + """, sz AS (SELECT q_idx, community_id, count(*) AS size FROM part GROUP BY ALL),
ov AS (SELECT c.q_idx, p.community_id AS prev, c.community_id AS curr, count(*) AS overlap FROM part c JOIN part p ON p.work_id = c.work_id AND p.q_idx + 1 = c.q_idx GROUP BY ALL),
o AS (SELECT ov.*, a.size AS size_prev, b.size AS size_curr FROM ov JOIN sz a ON a.q_idx + 1 = ov.q_idx AND a.community_id = prev JOIN sz b ON b.q_idx = ov.q_idx AND b.community_id = curr)"""


@query(OVERLAPS + "SELECT * FROM o")
def d025_core_overlaps(spark: SparkSession, sf_dir: str, quarters: list[int] = TWIN_QUARTERS) -> DataFrame:
    return C.core_overlaps(_partition(spark, sf_dir, quarters))


@query()
def d025_core_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_cores(C.core_overlaps(_partition(spark, sf_dir, _quarters(spark, sf_dir))))


@query(OVERLAPS + """, st AS (SELECT * FROM o WHERE overlap >= 10 AND overlap / least(size_prev, size_curr)::DOUBLE >= 0.08)
SELECT q_idx, 'split' AS event, prev AS community_id, count(DISTINCT curr) AS partners FROM st GROUP BY ALL HAVING count(DISTINCT curr) > 1 UNION ALL
SELECT q_idx, 'merge', curr, count(DISTINCT prev) FROM st GROUP BY ALL HAVING count(DISTINCT prev) > 1""")
def d026_overlap_events(spark: SparkSession, sf_dir: str, quarters: list[int] = TWIN_QUARTERS) -> DataFrame:
    return C.overlap_events(C.core_overlaps(_partition(spark, sf_dir, quarters)), share=0.08)


@query()
def d027_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _partition(spark, sf_dir, _quarters(spark, sf_dir))
    return C.assign_lineages(p, C.match_cores(C.core_overlaps(p)))


@query()
def d029_core_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _partition(spark, sf_dir, _quarters(spark, sf_dir))
    overlaps = C.core_overlaps(p)
    matches = C.match_cores(overlaps)
    return C.core_overlap_summary(overlaps, C.assign_lineages(p, matches), matches)


@query(PART + """SELECT c.community_id AS lineage_id, c.q_idx, count(*) AS n_nodes, round(avg((p.community_id <> c.community_id)::INT), 6) AS change_rate FROM part c JOIN part p ON p.work_id = c.work_id AND p.q_idx + 1 = c.q_idx GROUP BY ALL""")
def d030_label_change(spark: SparkSession, sf_dir: str, quarters: list[int] = TWIN_QUARTERS) -> DataFrame:
    return C.label_change_rate(_partition(spark, sf_dir, quarters).withColumnRenamed("community_id", "lineage_id")).withColumn("change_rate", F.round("change_rate", 6))


@query(PART + """SELECT p.q_idx, community_id, count(*) AS new_works FROM part p JOIN works w ON w.work_id = p.work_id AND w.q_idx = p.q_idx GROUP BY ALL""")
def d031_new_works(spark: SparkSession, sf_dir: str, quarters: list[int] = TWIN_QUARTERS) -> DataFrame:
    return _partition(spark, sf_dir, quarters).join(B.works(spark, sf_dir).select("work_id", "q_idx"), ["work_id", "q_idx"]).groupBy("q_idx", "community_id").agg(F.count(F.lit(1)).alias("new_works"))


@query(PART + """, s AS (SELECT q_idx, community_id, count(*) AS size FROM part GROUP BY ALL)
SELECT q_idx, count(*) AS communities, min(size) AS size_min, round(median(size), 6) AS size_median, round(avg(size), 6) AS size_mean, round(quantile_cont(size, 0.9), 6) AS size_p90, max(size) AS size_max, count(*) FILTER (size > 700) AS oversized FROM s GROUP BY 1""")
def d032_community_sizes(spark: SparkSession, sf_dir: str, quarters: list[int] = TWIN_QUARTERS) -> DataFrame:
    return C.community_sizes(_partition(spark, sf_dir, quarters), 700).select("q_idx", "communities", "size_min", "size_max", "oversized", *rounded(["size_median", "size_mean", "size_p90"]))


def _quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.edges_by_quarter(_edges(spark, sf_dir), _quarters(spark, sf_dir))


@query()
def d020_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.detect_communities(_quarterly(spark, sf_dir), resolution=0.05, least=3)


@query()
def d021_consensus_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.detect_communities(_quarterly(spark, sf_dir), resolution=0.05, least=3, runs=16)


@query()
def d024_pagerank_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = F.array(*[F.lit(q) for q in _quarters(spark, sf_dir)]).cast("array<int>")
    p = B.works(spark, sf_dir).select("work_id", (F.col("author_id") % 12).alias("community_id"), F.explode(F.filter(quarters, lambda q: q >= F.col("q_idx"))).alias("q_idx"))
    return C.pagerank_cores(_quarterly(spark, sf_dir), p).withColumn("rank", F.round("rank", 9))


@query()
def d033_resolution_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolution_sweep(_quarterly(spark, sf_dir), [0.02, 0.1], least=2)


MISFIT = EDGES + """, p AS (SELECT work_id, (author_id % 12)::BIGINT AS community_id FROM k), sz AS (SELECT community_id, count(*) AS n FROM p GROUP BY 1),
l AS (SELECT s.work_id, s.community_id AS own, d.community_id AS to_, count(*) AS c FROM edges e JOIN p s ON src = s.work_id JOIN p d ON dst = d.work_id GROUP BY ALL),
n AS (SELECT work_id, own, o.n AS own_size, sum(c)::BIGINT AS links, sum(CASE WHEN own = to_ THEN c ELSE 0 END) AS inside, COALESCE(min(CASE WHEN own <> to_ THEN 1 - c / t.n::DOUBLE END), 1) AS b FROM l JOIN sz t ON to_ = t.community_id JOIN sz o ON own = o.community_id GROUP BY work_id, own, o.n HAVING sum(c) >= 4),
a AS (SELECT *, CASE WHEN own_size > 1 THEN 1 - inside / (own_size - 1)::DOUBLE ELSE 0 END AS a FROM n)"""


@query(MISFIT + """SELECT work_id, own AS community_id, links, round(inside / links::DOUBLE, 6) AS within_share, round(CASE WHEN own_size > 1 THEN COALESCE((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END, 6) AS silhouette,
  inside / links::DOUBLE <= 0.1 AND (b - a) < 0 AND own_size > 1 AS misfit FROM a""")
def d023_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _corpus(spark, sf_dir).select("work_id", (F.col("author_id") % 12).alias("community_id"))
    return C.misfit_flags(_edges(spark, sf_dir), p, min_links=4).select("work_id", "community_id", "links", *rounded(["within_share", "silhouette"]), "misfit")


LIVES = with_(SERIES) + ", thin AS (SELECT * FROM series WHERE q_idx % (1 + lineage_id % 9) = 0), life AS (SELECT lineage_id, count(DISTINCT q_idx) AS lifespan FROM thin GROUP BY 1)"


def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with quarters left out, more for some lineages, so that lifespans differ."""
    return B.series(spark, sf_dir).where(F.col("q_idx") % (1 + F.col("lineage_id") % 9) == 0)


@query(LIVES + "SELECT * FROM life")
def d035_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lifespans(_thin(spark, sf_dir))


@query(LIVES + "SELECT thin.* FROM thin WHERE lineage_id IN (SELECT lineage_id FROM life WHERE lifespan BETWEEN 5 AND 10)")
def d035_stable_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stable_lineages(_thin(spark, sf_dir), 5, 10)


@query(LIVES + """SELECT count(*) AS lineages, round(avg(lifespan), 6) AS mean, floor(median(lifespan))::BIGINT AS median, round(stddev_pop(lifespan), 6) AS std, round(quantile_cont(lifespan, 0.25), 6) AS p25, round(quantile_cont(lifespan, 0.75), 6) AS p75,
  max(lifespan) AS longest, count(*) FILTER (lifespan = 1) AS from_1, count(*) FILTER (lifespan BETWEEN 2 AND 3) AS from_2, count(*) FILTER (lifespan BETWEEN 4 AND 7) AS from_4, count(*) FILTER (lifespan BETWEEN 8 AND 11) AS from_8,
  count(*) FILTER (lifespan BETWEEN 12 AND 19) AS from_12, count(*) FILTER (lifespan BETWEEN 20 AND 39) AS from_20, count(*) FILTER (lifespan >= 40) AS from_40 FROM life""")
def d036_stability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.stability_report(_thin(spark, sf_dir))
    return r.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p75")})


@query(PART + "SELECT community_id AS lineage_id, work_id, min(q_idx) AS first_q FROM part GROUP BY ALL")
def d037_lineage_papers(spark: SparkSession, sf_dir: str, quarters: list[int] = TWIN_QUARTERS) -> DataFrame:
    p = _partition(spark, sf_dir, quarters)
    registry = p.select("q_idx", "community_id").distinct().withColumn("lineage_id", F.col("community_id"))
    return C.lineage_papers(registry, p)


@query(LIVES + "SELECT lineage_id FROM life WHERE lifespan >= 6")
def d038_persistent_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stable_lineages(_thin(spark, sf_dir), 6).select("lineage_id").distinct()


@query(LIVES + """, b AS (SELECT CASE WHEN lifespan >= 32 THEN 32 WHEN lifespan >= 16 THEN 16 WHEN lifespan >= 8 THEN 8 WHEN lifespan >= 4 THEN 4 WHEN lifespan >= 2 THEN 2 ELSE 1 END::INTEGER AS bracket, count(*) AS lineages FROM life GROUP BY 1)
SELECT bracket, lineages, round(lineages / (sum(lineages) OVER ())::DOUBLE, 6) AS share, (sum(lineages) OVER (ORDER BY bracket DESC))::BIGINT AS survivors FROM b""")
def d130_stratification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stratify(_thin(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query()
def d054_tight_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lineage_id"))
    grid = s.withColumn("event_id", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return C.greedy_tight_matches(grid.withColumn("similarity", (F.col("lineage_id") * 31 + F.col("event_id") * 17) % 101 / F.lit(101.0)))


@query(PART + """, m AS (SELECT community_id AS lineage_id, work_id, min(q_idx) AS q_idx FROM part GROUP BY ALL) SELECT lineage_id, q_idx, count(*) AS new_papers FROM m GROUP BY ALL""")
def d071_new_papers(spark: SparkSession, sf_dir: str, quarters: list[int] = TWIN_QUARTERS) -> DataFrame:
    return convergence.new_papers(_partition(spark, sf_dir, quarters).withColumnRenamed("community_id", "lineage_id"))


LINEAGE = CORPUS + ", lin AS (SELECT work_id, (author_id % 12)::BIGINT AS lineage_id, q_idx, author_id FROM k)"


def _lineage_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("work_id", (F.col("author_id") % 12).alias("lineage_id"), "q_idx", "author_id")


@query(LINEAGE + """SELECT a.lineage_id, count(*) AS resolved, round(avg((a.lineage_id <> b.lineage_id)::INT), 6) AS cross_share FROM refs r JOIN lin a ON r.work_id = a.work_id JOIN lin b ON ref_id = b.work_id GROUP BY 1""")
def d073_cross_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.cross_lineage_share(B.refs(spark, sf_dir), _lineage_of(spark, sf_dir)).withColumn("cross_share", F.round("cross_share", 6))


@query(CORPUS + """, f AS (SELECT work_id AS focal, pub_year AS fy FROM k WHERE work_id % 7 = 0), c AS (SELECT DISTINCT r.work_id AS citer, ref_id AS cited, pub_year AS cy FROM refs r JOIN works w ON w.work_id = r.work_id),
d AS (SELECT DISTINCT focal, citer FROM f JOIN c ON focal = cited WHERE cy > fy), t AS (SELECT DISTINCT f.focal, c.citer FROM f JOIN refs r ON r.work_id = f.focal JOIN c ON c.cited = r.ref_id WHERE cy > fy AND c.citer <> f.focal),
b AS (SELECT COALESCE(d.focal, t.focal) AS focal, d.citer IS NOT NULL AS dd, t.citer IS NOT NULL AS tt FROM d FULL JOIN t ON d.focal = t.focal AND d.citer = t.citer),
s AS (SELECT focal, count(*) FILTER (dd AND NOT tt) AS n_u, count(*) FILTER (dd AND tt) AS n_v, count(*) FILTER (NOT dd AND tt) AS n_w FROM b GROUP BY 1)
SELECT f.focal AS work_id, COALESCE(n_u, 0) AS n_u, COALESCE(n_v, 0) AS n_v, COALESCE(n_w, 0) AS n_w, round((n_u - n_v) / nullif(n_u + n_v + n_w, 0)::DOUBLE, 6) AS cd_index FROM f LEFT JOIN s ON f.focal = s.focal""")
def d074_disruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    focal = _corpus(spark, sf_dir).where("work_id % 7 = 0")
    return convergence.disruption(B.works(spark, sf_dir), B.refs(spark, sf_dir), focal).withColumn("cd_index", F.round("cd_index", 6))


@query()
def d074_disruption_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every work of the corpus; d074_disruption and its SQL twin take a seventh of them."""
    focal = _corpus(spark, sf_dir)
    return convergence.disruption(B.works(spark, sf_dir), B.refs(spark, sf_dir), focal).withColumn("cd_index", F.round("cd_index", 6))


@query(LINEAGE.replace("(author_id % 12)", "(work_id % 12)") + """, p AS (SELECT DISTINCT lineage_id, q_idx, author_id FROM lin), s AS (SELECT q_idx, author_id, count(*) AS n FROM p GROUP BY ALL)
SELECT lineage_id, q_idx, count(*) AS authors, count(*) FILTER (n > 1) AS migrating, round(count(*) FILTER (n > 1) / count(*)::DOUBLE, 6) AS migration_rate FROM p JOIN s USING (q_idx, author_id) GROUP BY ALL""")
def d079_author_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lineage_of(spark, sf_dir).withColumn("lineage_id", F.col("work_id") % 12)
    return convergence.author_migration(a).withColumn("migration_rate", F.round("migration_rate", 6))


@query(LINEAGE + """, h AS (SELECT r.work_id, count(DISTINCT lineage_id) AS n FROM refs r JOIN lin ON ref_id = lin.work_id GROUP BY 1)
SELECT lineage_id, count(*) AS papers, count(*) FILTER (n >= 2) AS bridges, round(count(*) FILTER (n >= 2) / count(*)::DOUBLE, 6) AS bridge_rate FROM lin LEFT JOIN h USING (work_id) GROUP BY 1""")
def d080_citation_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.citation_bridges(B.refs(spark, sf_dir), _lineage_of(spark, sf_dir)).withColumn("bridge_rate", F.round("bridge_rate", 6))


@query(with_(SERIES) + """, f AS (SELECT lineage_id, q_idx, (new_works % 7) / 7.0::DOUBLE AS max_sim, (new_works % 5) / 5.0::DOUBLE AS mig, (q_idx % 3) / 3.0::DOUBLE AS br, (lineage_id % 4) / 4.0::DOUBLE AS ov FROM series),
c AS (SELECT *, (max_sim + mig + br + ov) / 4 AS composite, COALESCE(max_sim - lag(max_sim) OVER (PARTITION BY lineage_id ORDER BY q_idx), 0) AS velocity FROM f),
r AS (SELECT *, avg(composite) OVER (PARTITION BY lineage_id ORDER BY q_idx ROWS 1 PRECEDING) AS roll_2, avg(composite) OVER y AS roll_4, list(composite) OVER y AS held FROM c WINDOW y AS (PARTITION BY lineage_id ORDER BY q_idx ROWS 3 PRECEDING))
SELECT lineage_id, q_idx, round(composite, 6) AS composite, round(velocity, 6) AS velocity, round(roll_2, 6) AS roll_2, round(roll_4, 6) AS roll_4, round(list_max(list_transform(held, lambda x: abs(x - roll_4))), 6) AS max_dev FROM r""")
def d082_convergence_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir)
    f = s.select("lineage_id", "q_idx", (F.col("new_works") % 7 / F.lit(7.0)).alias("max_sim"), (F.col("new_works") % 5 / F.lit(5.0)).alias("migration_rate"), (F.col("q_idx") % 3 / F.lit(3.0)).alias("bridge_rate"), (F.col("lineage_id") % 4 / F.lit(4.0)).alias("term_overlap"))
    return convergence.convergence_composite(f).select("lineage_id", "q_idx", *rounded(["composite", "velocity", "roll_2", "roll_4", "max_dev"]))


for _twin in (d028_variation_of_information, d025_core_overlaps, d026_overlap_events, d030_label_change, d031_new_works, d032_community_sizes, d037_lineage_papers, d071_new_papers):
    _over_all_quarters(_twin)
