"""Queries on engineered features, scoped graphs and trackers, lifecycles, sweeps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions.numeric import rounded
from tidemark.operators import communities as C
from tidemark.operators import detectors as D
from tidemark.operators import evaluation as E
from tidemark.operators import features, graph, series, signals
from tidemark.plans import bindings as B
from tidemark.plans.bindings import MAPPING, REFS, SERIES, WORKS, with_
from tidemark.plans.graph_plans import EDGES, _corpus, _edges
from tidemark.plans.series_plans import BACKGROUND, EVENTS, FRONTS, ONSETS, _fronts, _marks
from tidemark.plans.text_plans import SIGNALS, _signals

RAW_SIGNALS = with_(SERIES) + """, n AS (SELECT *, row_number() OVER o AS r FROM series WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)),
s AS (SELECT *, r - 1 - COALESCE(max(CASE WHEN new_works > 1 THEN r END) OVER (PARTITION BY lineage_id ORDER BY q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM n),
raw AS (SELECT lineage_id, q_idx, new_works, (new_works % 7) / 7.0::DOUBLE AS semantic_velocity, (q_idx % 5) / 5.0::DOUBLE AS novelty_rate, new_works % 4 AS n_new_papers, CASE WHEN new_works > 1 AND streak > 0 THEN new_works * streak ELSE 0 END AS awakening_intensity,
  new_works % 6 AS cross_domain_refs, new_works % 9 AS within_lineage_refs, (new_works % 3 - 1) / 2.0::DOUBLE AS cd_index, new_works % 8 AS n_papers_cd FROM s),
t AS (SELECT *, sum(new_works) OVER (PARTITION BY lineage_id ORDER BY q_idx) AS total_works FROM raw),
g AS (SELECT *, COALESCE((total_works - lag(total_works) OVER o) / nullif(lag(total_works) OVER o, 0)::DOUBLE, 0) AS growth_rate FROM t WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)),
eng AS (SELECT *, COALESCE(semantic_velocity - lag(semantic_velocity) OVER o, 0) AS velocity_acceleration, COALESCE(growth_rate - lag(growth_rate) OVER o, 0) AS growth_acceleration, novelty_rate * n_new_papers AS novelty_momentum,
  (awakening_intensity > 0)::INTEGER AS is_awakening, cross_domain_refs / (within_lineage_refs + 1)::DOUBLE AS citation_balance, cd_index * n_papers_cd AS disruption_intensity FROM g WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx))"""


def _engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir)
    quiet = series.dormancy(s.withColumn("active", F.when(F.col("new_works") > 1, F.col("new_works")).otherwise(0)), ["lineage_id"], "active")
    n = F.col("new_works")
    raw = quiet.select(
        "lineage_id", "q_idx", "new_works", (n % 7 / F.lit(7.0)).alias("semantic_velocity"), (F.col("q_idx") % 5 / F.lit(5.0)).alias("novelty_rate"), (n % 4).alias("n_new_papers"),
        F.when((F.col("active") > 0) & (F.col("streak") > 0), F.col("awakening")).otherwise(0).alias("awakening_intensity"),
        (n % 6).alias("cross_domain_refs"), (n % 9).alias("within_lineage_refs"), ((n % 3 - 1) / F.lit(2.0)).alias("cd_index"), (n % 8).alias("n_papers_cd"),
    )
    return features.engineered(raw)


_MADE = ["growth_rate", "velocity_acceleration", "growth_acceleration", "novelty_momentum", "citation_balance", "disruption_intensity"]


@query(RAW_SIGNALS + "SELECT lineage_id, q_idx, total_works::BIGINT AS total_works, is_awakening, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MADE) + " FROM eng")
def d085_engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engineered(spark, sf_dir).select("lineage_id", "q_idx", "total_works", "is_awakening", *rounded(_MADE))


@query(RAW_SIGNALS + """SELECT lineage_id, q_idx, round(semantic_velocity, 6) AS semantic_velocity, round(velocity_acceleration, 6) AS velocity_acceleration, round(growth_rate, 6) AS growth_rate, round(growth_acceleration, 6) AS growth_acceleration,
  new_works, total_works::BIGINT AS total_works, round(novelty_rate, 6) AS novelty_rate, round(novelty_momentum, 6) AS novelty_momentum, awakening_intensity::BIGINT AS awakening_intensity, is_awakening, cross_domain_refs, within_lineage_refs, round(citation_balance, 6) AS citation_balance FROM eng""")
def d086_leakage_safe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry selects of the engineered table when columns that use later data must go."""
    table = _engineered(spark, sf_dir)
    chosen = features.select_features(table.columns, leakage_safe=True)
    real = {c for c, kind in table.dtypes if kind == "double"}
    return table.select("lineage_id", "q_idx", *[F.round(c, 6).alias(c) if c in real else F.col(c) for c in chosen])


@query(EDGES + """SELECT 'cumulative' AS scope, count(*) AS edges, COALESCE(sum(src + dst), 0)::BIGINT AS ends FROM edges WHERE valid_from_q <= 7990
UNION ALL SELECT 'annual', count(*), COALESCE(sum(e.src + e.dst), 0)::BIGINT FROM edges e JOIN k a ON e.src = a.work_id JOIN k b ON e.dst = b.work_id WHERE a.q_idx // 4 <= 7990 // 4 AND b.q_idx // 4 <= 7990 // 4
UNION ALL SELECT 'delta', count(*), COALESCE(sum(e.src + e.dst), 0)::BIGINT FROM edges e JOIN k a ON e.src = a.work_id JOIN k b ON e.dst = b.work_id WHERE a.q_idx = 7990 AND b.q_idx = 7990""")
def d015_scoped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, works, edges = None, _corpus(spark, sf_dir), _edges(spark, sf_dir)
    for scope in ("cumulative", "annual", "delta"):
        one = graph.edges_at(edges, works, 7990, scope).agg(F.lit(scope).alias("scope"), F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(F.col("src") + F.col("dst")), F.lit(0)).cast("long").alias("ends"))
        out = one if out is None else out.unionByName(one)
    return out


@query(EDGES + """, n AS (SELECT q_idx, (sum(c) OVER (ORDER BY q_idx))::DOUBLE AS n FROM (SELECT q_idx, count(*) AS c FROM k GROUP BY 1)), m AS (SELECT n.q_idx, n, (SELECT count(*) FROM edges e WHERE e.valid_from_q <= n.q_idx) AS m FROM n)
SELECT q_idx, n::BIGINT AS nodes, round(m / n, 6) AS avg_degree, greatest(10, ceil(n * 0.0005::DOUBLE))::BIGINT AS size_min,
  CASE WHEN m / n < 0.2 THEN least(15000, ceil(n * 0.05::DOUBLE)) ELSE least(greatest(400, greatest(10, ceil(n * 0.02::DOUBLE))), least(15000, ceil(n * 0.1::DOUBLE))) END::BIGINT AS size_max FROM m""".replace("least(15000, ceil(n * 0.05::DOUBLE)) ELSE", "least(400, ceil(n * 0.05::DOUBLE)) ELSE"))
def d022_size_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = graph.graph_stats_by_quarter(_corpus(spark, sf_dir), _edges(spark, sf_dir))
    return graph.size_bounds(stats, most=400, sparse_degree=0.2).withColumn("avg_degree", F.round("avg_degree", 6))


PART_ALL = with_(WORKS) + """, part AS (SELECT q.q_idx, w.work_id, w.q_idx AS first_q, ((w.author_id + CASE WHEN w.work_id % 10 = q.q_idx % 10 THEN 1 ELSE 0 END) % 12)::BIGINT AS community_id
  FROM works w JOIN (SELECT DISTINCT q_idx FROM works) q ON w.q_idx <= q.q_idx)"""
_VI = """, c{0} AS (SELECT b.q_idx, a.community_id AS x, b.community_id AS y, count(*) AS n FROM part a JOIN part b ON a.work_id = b.work_id AND a.q_idx + {1} = b.q_idx {2} GROUP BY ALL),
t{0} AS (SELECT *, sum(n) OVER (PARTITION BY q_idx) AS total, sum(n) OVER (PARTITION BY q_idx, x) AS nx, sum(n) OVER (PARTITION BY q_idx, y) AS ny FROM c{0}),
v{0} AS (SELECT q_idx, '{0}' AS variant, greatest(-sum(n / total::DOUBLE * (log2(n / nx::DOUBLE) + log2(n / ny::DOUBLE))), 0) AS vi, max(total)::BIGINT AS n_nodes FROM t{0} GROUP BY 1)"""


def _whole_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic partition of the works of every quarter of the data, in which some works move."""
    w = B.works(spark, sf_dir)
    quarters = F.broadcast(w.where("q_idx IS NOT NULL").agg(F.array_sort(F.collect_set("q_idx")).alias("quarters")))  # one row of a few dozen numbers
    rows = w.select("work_id", "author_id", F.col("q_idx").alias("first_q")).crossJoin(quarters)
    rows = rows.withColumn("q_idx", F.explode(F.filter("quarters", lambda q: q >= F.col("first_q"))))
    moved = F.when(F.col("work_id") % 10 == F.col("q_idx") % 10, 1).otherwise(0)
    return rows.select("q_idx", "work_id", "first_q", ((F.col("author_id") + moved) % 12).cast("long").alias("community_id"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _whole_partition(spark, sf_dir)
    out = None
    for name, step, kept in (("qoq", 1, F.lit(True)), ("recent", 1, F.col("first_q") > F.col("q_idx") - 8), ("yoy", 4, F.lit(True)), ("twenty", 20, F.lit(True))):
        before = p.withColumn("q_idx", F.col("q_idx") + step)
        one = C.variation_of_information(before, p.where(kept), ["q_idx"], union=False).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


VARIANTS = PART_ALL + _VI.format("qoq", 1, "") + _VI.format("recent", 1, "AND b.first_q > b.q_idx - 8") + _VI.format("yoy", 4, "") + _VI.format("twenty", 20, "") + ", v AS (SELECT * FROM vqoq UNION ALL SELECT * FROM vrecent UNION ALL SELECT * FROM vyoy UNION ALL SELECT * FROM vtwenty)"


@query(VARIANTS + "SELECT variant, q_idx, round(vi, 6) AS vi, n_nodes, round(CASE WHEN n_nodes > 1 THEN vi / log2(n_nodes) ELSE 0 END, 6) AS nvi FROM v")
def d028_vi_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter on quarter, on works of the last two years, on the year before and on 20 quarters before; on the works of both."""
    return _variants(spark, sf_dir).select("variant", "q_idx", "n_nodes", *rounded(["vi", "nvi"]))


@query(VARIANTS + """, p AS (SELECT vi, floor((row_number() OVER (ORDER BY q_idx) - 1) * 3 / count(*) OVER ()) AS third FROM v WHERE variant = 'qoq'),
m AS (SELECT avg(vi) FILTER (third = 0) AS early, avg(vi) FILTER (third = 1) AS middle, avg(vi) FILTER (third = 2) AS late FROM p)
SELECT round(early, 6) AS early, round(middle, 6) AS middle, round(late, 6) AS late, CASE WHEN late < 0.95 * early THEN 'falling' WHEN late > 1.05 * early THEN 'rising' ELSE 'stable' END AS trend FROM m""")
def d036_vi_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.trend_by_thirds(_variants(spark, sf_dir).where("variant = 'qoq'"), "vi")
    return t.select(*rounded(["early", "middle", "late"]), "trend")


@query(PART_ALL + """SELECT community_id AS lineage_id, (max(q_idx) - min(q_idx) + 1)::INTEGER AS span, count(DISTINCT q_idx) AS active, round(count(DISTINCT q_idx) / (max(q_idx) - min(q_idx) + 1)::DOUBLE, 6) AS share FROM part GROUP BY 1""")
def d036_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _whole_partition(spark, sf_dir)
    registry = p.select("q_idx", "community_id").distinct().withColumn("lineage_id", F.col("community_id"))
    return C.activity(p, registry).withColumn("share", F.round("share", 6))


DELTA = with_(WORKS) + """, d AS (SELECT q_idx AS period, work_id, (author_id % 12)::BIGINT AS community_id FROM works WHERE q_idx % 5 <> 0),
pl AS (SELECT period, (row_number() OVER (ORDER BY period) - 1)::INTEGER AS q_idx FROM (SELECT DISTINCT period FROM d)), part AS (SELECT d.*, q_idx FROM d JOIN pl USING (period))"""


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of single quarters; one quarter in five has no graph, as happens when a file is missing."""
    d = B.works(spark, sf_dir).where("q_idx % 5 <> 0").select(F.col("q_idx").alias("period"), "work_id", (F.col("author_id") % 12).cast("long").alias("community_id"))
    return C.scoped_partition(d, "period")


@query(DELTA + "SELECT period, q_idx, community_id, count(*) AS new_works FROM part GROUP BY ALL")
def d034_delta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In delta graphs all members of a community are new."""
    return _delta(spark, sf_dir).groupBy("period", "q_idx", "community_id").agg(F.count(F.lit(1)).alias("new_works"))


ANNUAL = with_(WORKS) + """, y AS (SELECT DISTINCT pub_year AS period FROM works WHERE pub_year % 5 <> 0), pl AS (SELECT period, (row_number() OVER (ORDER BY period) - 1)::INTEGER AS q_idx FROM y),
part AS (SELECT pl.q_idx, period, work_id, ((author_id + CASE WHEN work_id % 10 = period % 10 THEN 1 ELSE 0 END) % 12)::BIGINT AS community_id FROM works JOIN pl ON pub_year <= period),
sz AS (SELECT q_idx, community_id, count(*) AS size FROM part GROUP BY ALL), ov AS (SELECT c.q_idx, p.community_id AS prev, c.community_id AS curr, count(*) AS overlap FROM part c JOIN part p ON p.work_id = c.work_id AND p.q_idx + 1 = c.q_idx GROUP BY ALL)"""


@query(ANNUAL + "SELECT ov.q_idx, prev, curr, overlap, a.size AS size_prev, b.size AS size_curr FROM ov JOIN sz a ON a.q_idx + 1 = ov.q_idx AND a.community_id = prev JOIN sz b ON b.q_idx = ov.q_idx AND b.community_id = curr")
def d034_annual_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of yearly graphs against those of the year before that has one."""
    w = B.works(spark, sf_dir)
    years = F.broadcast(w.where("pub_year % 5 <> 0").agg(F.array_sort(F.collect_set("pub_year")).alias("years")))  # one row
    rows = w.crossJoin(years).withColumn("period", F.explode(F.filter("years", lambda y: y >= F.col("pub_year"))))
    moved = F.when(F.col("work_id") % 10 == F.col("period") % 10, 1).otherwise(0)
    part = C.scoped_partition(rows.select("period", "work_id", ((F.col("author_id") + moved) % 12).cast("long").alias("community_id")), "period")
    return C.core_overlaps(part)


@query(with_(SIGNALS) + """, p AS (SELECT *, row_number() OVER (PARTITION BY lineage, signal ORDER BY similarity DESC, front) AS place, min(similarity) OVER (PARTITION BY lineage, signal) AS lo, max(similarity) OVER (PARTITION BY lineage, signal) AS hi FROM signals),
sh AS (SELECT *, (similarity - lo) / (hi - lo) AS s FROM p), pr AS (SELECT *, s / sum(s) OVER (PARTITION BY lineage, signal) AS p FROM sh),
k AS (SELECT lineage, signal, max(similarity) AS top, max(similarity) - max(similarity) FILTER (place = 2) AS margin, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy, max(front) FILTER (place = 1) AS best FROM pr GROUP BY ALL),
o AS (SELECT a.lineage, a.signal, a.best <> b.best AND b.best = c.best AS odd FROM k a JOIN k b ON a.lineage = b.lineage AND b.signal = a.signal % 3 + 1 JOIN k c ON a.lineage = c.lineage AND c.signal = (a.signal + 1) % 3 + 1),
g AS (SELECT k.signal, avg(margin) * avg((margin > 0.1)::INT) AS d, 1 / (avg(entropy) + 0.1) AS e, count(*) FILTER (odd) AS odd, stddev_pop(top) AS v, avg(margin) AS mean_margin, avg(entropy) AS mean_entropy FROM k JOIN o USING (lineage, signal) GROUP BY 1),
w AS (SELECT *, 0.35 * d / max(d) OVER () + 0.25 * e / max(e) OVER () + 0.2 * CASE WHEN sum(odd) OVER () > 0 THEN 1 - odd / (sum(odd) OVER ())::DOUBLE ELSE 1 END + 0.2 * v / max(v) OVER () AS raw FROM g)
SELECT signal::INTEGER AS signal, round(mean_margin, 6) AS mean_margin, round(mean_entropy, 6) AS mean_entropy, odd AS odd_one_out, round(raw / sum(raw) OVER () * 3, 6) AS weight FROM w""")
def d053_stage_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.stage_weights(_signals(spark, sf_dir)).select("signal", *rounded(["mean_margin", "mean_entropy", "weight"]), "odd_one_out")


@query(with_(SERIES, MAPPING) + ONSETS + """, fo AS (SELECT front, min(onset_q) AS onset_q, count(onset_q) AS onset_lineages FROM (SELECT lineage_id, CASE WHEN n >= 6 THEN onset_q END AS onset_q FROM ons) JOIN mapping USING (lineage_id) GROUP BY 1),
named AS (SELECT front, q_idx, new_works FROM series JOIN mapping USING (lineage_id)), d AS (SELECT front, q_idx, COALESCE(sum(new_works), 0) AS n
  FROM (SELECT front, unnest(range((SELECT min(q_idx) FROM named), (SELECT max(q_idx) FROM named) + 1))::INTEGER AS q_idx FROM (SELECT DISTINCT front FROM named)) LEFT JOIN named USING (front, q_idx) GROUP BY ALL),
r AS (SELECT *, avg(n) OVER (PARTITION BY front ORDER BY q_idx ROWS 3 PRECEDING) AS m FROM d), f AS (SELECT *, COALESCE((m < lag(m) OVER (PARTITION BY front ORDER BY q_idx))::INT, 0) AS falling FROM r),
i AS (SELECT *, sum(1 - falling) OVER (PARTITION BY front ORDER BY q_idx) AS island FROM f), l AS (SELECT *, (sum(falling) OVER (PARTITION BY front, island ORDER BY q_idx))::BIGINT AS decline FROM i)
SELECT front, q_idx, decline AS decline_streak, onset_q, onset_lineages, CASE WHEN q_idx >= onset_q THEN q_idx - onset_q END AS since_onset,
  CASE WHEN onset_q IS NULL THEN 'no_onset' WHEN q_idx < onset_q THEN 'pre_onset' WHEN q_idx - onset_q <= 12 THEN 'growth' WHEN decline >= 4 THEN 'decline' ELSE 'mature' END AS stage FROM l LEFT JOIN fo USING (front)""")
def d083_front_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = B.series(spark, sf_dir), B.mapping(spark, sf_dir)
    return series.front_lifecycle(series.front_series(s, m), D.onsets(s, ["lineage_id"], growth=0.05), m)


@query(BACKGROUND.replace("count(count) OVER p", "count(count) FILTER (count >= 25) OVER p").replace("avg(count) OVER p", "avg(count) FILTER (count >= 25) OVER p").replace("var_samp(count) OVER p", "var_samp(count) FILTER (count >= 25) OVER p").replace("history >= 8", "history >= 4")
       + "SELECT front, q_idx, count, history, round(mu, 6) AS mu, round(variance, 6) AS variance, model FROM bg")
def d088_background_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.burst_background(_fronts(spark, sf_dir), ["front"], need=4, min_count=25)
    return b.select("front", "q_idx", "count", "history", *rounded(["mu", "variance"]), "model")


@query(FRONTS + """, p AS (SELECT front, q_idx, (count % 37) / 100.0::DOUBLE AS probability FROM fronts), c AS (SELECT *, probability - lag(probability) OVER (PARTITION BY front ORDER BY q_idx) AS change FROM p),
t AS (SELECT *, CASE WHEN probability >= 0.15 THEN 'watch' WHEN probability >= 0.07 THEN 'extended' ELSE 'none' END AS tier FROM c WHERE q_idx = (SELECT max(q_idx) FROM p))
SELECT q_idx, tier, front, round(probability, 6) AS probability, round(change, 6) AS change, (row_number() OVER (ORDER BY probability DESC, front))::INTEGER AS place FROM t WHERE tier <> 'none' ORDER BY probability DESC, front LIMIT 10""")
def d110_briefing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _fronts(spark, sf_dir).select("front", "q_idx", (F.col("count") % 37 / F.lit(100.0)).alias("probability"))
    return E.briefing_rows(p, "front").select("q_idx", "tier", "front", *rounded(["probability", "change"]), "place")


@query(with_(SERIES, EVENTS) + """, j AS (SELECT s.lineage_id, s.q_idx, s.q_idx - e.event_q AS lag, row_number() OVER (PARTITION BY s.lineage_id, s.q_idx ORDER BY abs(s.q_idx - e.event_q), e.event_q, e.event_id) AS n FROM series s LEFT JOIN marks e USING (lineage_id)),
k AS (SELECT lineage_id % 5 AS category, lag, abs(lag) AS a FROM j WHERE n = 1)
SELECT category, count(*) AS rows, round(count(lag) / count(*)::DOUBLE, 6) AS coverage, round(median(lag), 6) AS median_lag, round(avg(lag), 6) AS mean_lag, round(count(*) FILTER (a < 4) / count(*)::DOUBLE, 6) AS under_4,
  round(count(*) FILTER (a >= 4 AND a < 8) / count(*)::DOUBLE, 6) AS from_4, round(count(*) FILTER (a >= 8 AND a < 12) / count(*)::DOUBLE, 6) AS from_8, round(count(*) FILTER (a >= 12) / count(*)::DOUBLE, 6) AS from_12 FROM k GROUP BY 1""")
def d112_lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = series.nearest_event(B.series(spark, sf_dir), _marks(spark, sf_dir), ["lineage_id"]).withColumn("category", F.col("lineage_id") % 5)
    return E.lag_summary(n, "category").select("category", "rows", *rounded(["coverage", "median_lag", "mean_lag", "under_4", "from_4", "from_8", "from_12"]))


@query(with_(SERIES) + """, r AS (SELECT lineage_id, q_idx, (new_works % 11) / 10.0::DOUBLE AS probability, (q_idx % 4 = 0)::INTEGER AS is_onset, (new_works % 13)::DOUBLE AS magnitude FROM series),
m AS (SELECT *, avg(probability) OVER w AS mean, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY lineage_id ORDER BY q_idx ROWS 1 PRECEDING)),
f AS (SELECT *, probability >= 0.7 AND n = 2 AND mean >= 0.7 AS persistent, (SELECT quantile_cont(magnitude, 0.9) FROM r) AS cut FROM m),
d AS (SELECT lineage_id, q_idx, 'false_positive' AS kind, probability AS worth FROM f WHERE probability >= 0.7 AND is_onset = 0
  UNION ALL SELECT lineage_id, q_idx, 'false_negative', magnitude FROM f WHERE probability < 0.7 AND is_onset = 1 AND magnitude >= cut UNION ALL SELECT lineage_id, q_idx, 'not_persistent', probability FROM f WHERE probability >= 0.7 AND NOT persistent),
o AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY worth DESC, lineage_id, q_idx))::INTEGER AS place FROM d)
SELECT lineage_id, q_idx, kind, round(worth, 6) AS worth, place FROM o WHERE kind <> 'false_positive' OR place <= 50""")
def d131_label_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("new_works")
    r = B.series(spark, sf_dir).select("lineage_id", "q_idx", (n % 11 / F.lit(10.0)).alias("probability"), (F.col("q_idx") % 4 == 0).cast("int").alias("is_onset"), (n % 13).cast("double").alias("magnitude"))
    return D.label_disputes(r, ["lineage_id"]).select("lineage_id", "q_idx", "kind", F.round("worth", 6).alias("worth"), "place")
