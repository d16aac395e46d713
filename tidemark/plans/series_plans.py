"""Queries on series, lifecycle features and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions.numeric import rounded
from tidemark.operators import detectors as D
from tidemark.operators import metrics, series, signals
from tidemark.plans import bindings as B
from tidemark.plans.bindings import MAPPING, SERIES, with_


@query(with_(SERIES) + """, agg AS (
  SELECT q_idx, sum(new_works)::BIGINT AS total, avg(new_works) AS mean, median(new_works) AS median, count(*) AS active, quantile_cont(new_works, 0.5) AS p50, quantile_cont(new_works, 0.75) AS p75, quantile_cont(new_works, 0.9) AS p90
  FROM series GROUP BY 1),
w AS (SELECT *, (sum(total) OVER (ORDER BY q_idx))::BIGINT AS cumulative, avg(total) OVER r2 AS roll_mean_2, avg(total) OVER r4 AS roll_mean_4, COALESCE(stddev_samp(total) OVER r4, 0) AS roll_std_4,
  total - lag(total) OVER o AS delta, total - lag(total, 4) OVER o AS yoy_delta, COALESCE(total / nullif(lag(total, 4) OVER o, 0)::DOUBLE, 0) AS yoy_ratio, median(total) OVER (PARTITION BY q_idx % 4) AS seasonal_median
  FROM agg WINDOW o AS (ORDER BY q_idx), r2 AS (ORDER BY q_idx ROWS 1 PRECEDING), r4 AS (ORDER BY q_idx ROWS 3 PRECEDING)),
g AS (SELECT *, COALESCE(cumulative / (lag(cumulative) OVER (ORDER BY q_idx))::DOUBLE - 1, 0) AS cum_growth FROM w)
SELECT q_idx, total, active, cumulative, delta, yoy_delta, round(mean, 6) AS mean, round(median, 6) AS median, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p90, 6) AS p90, round(roll_mean_2, 6) AS roll_mean_2,
  round(roll_mean_4, 6) AS roll_mean_4, round(roll_std_4, 6) AS roll_std_4, round(yoy_ratio, 6) AS yoy_ratio, round(seasonal_median, 6) AS seasonal_median, round(total - seasonal_median, 6) AS seasonal_adjusted,
  round(cum_growth, 6) AS cum_growth, round(COALESCE(cum_growth - lag(cum_growth) OVER (ORDER BY q_idx), 0), 6) AS acceleration FROM g""")
def d062_field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.field_metrics(B.series(spark, sf_dir))
    return m.select("q_idx", "total", "active", "cumulative", "delta", "yoy_delta", *rounded(["mean", "median", "p50", "p75", "p90", "roll_mean_2", "roll_mean_4", "roll_std_4", "yoy_ratio", "seasonal_median", "seasonal_adjusted", "cum_growth", "acceleration"]))


FRONTS = with_(SERIES, MAPPING) + """, fronts AS (SELECT front, q_idx, sum(new_works)::BIGINT AS count FROM series JOIN mapping USING (lineage_id) GROUP BY ALL)"""


def _fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rollup_fronts(B.series(spark, sf_dir), B.mapping(spark, sf_dir))


@query(FRONTS + "SELECT front, q_idx, count, (sum(count) OVER (PARTITION BY front ORDER BY q_idx))::BIGINT AS cumulative FROM fronts")
def d063_front_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fronts(spark, sf_dir)


@query(FRONTS + """
SELECT q_idx, COALESCE(sum(count) FILTER (front LIKE '%A'), 0)::BIGINT AS ends_a, COALESCE(sum(count) FILTER (front NOT LIKE '%A'), 0)::BIGINT AS other FROM fronts GROUP BY 1""")
def d063_wide_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fronts(spark, sf_dir).withColumn("side", F.when(F.col("front").like("%A"), "ends_a").otherwise("other"))
    return series.wide(f, "side", "count", ["ends_a", "other"])


@query(FRONTS + """, w AS (SELECT q_idx, COALESCE(sum(count) FILTER (front LIKE '%A'), 0)::BIGINT AS ends_a, COALESCE(sum(count) FILTER (front NOT LIKE '%A'), 0)::BIGINT AS other FROM fronts GROUP BY 1)
SELECT q_idx, 'ends_a' AS front, ends_a AS count FROM w UNION ALL SELECT q_idx, 'other', other FROM w""")
def d064_long_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.long(d063_wide_fronts(spark, sf_dir), ["ends_a", "other"])


SPARSE = with_(SERIES) + """, sparse AS (SELECT * FROM series WHERE (lineage_id + q_idx) % 3 <> 0),
ends AS (SELECT lineage_id, min(q_idx) AS lo, max(q_idx) AS hi FROM sparse GROUP BY 1),
grid AS (SELECT lineage_id, unnest(range(lo, hi + 1))::INTEGER AS q_idx FROM ends),
dense AS (SELECT lineage_id, q_idx, COALESCE(new_works, 0)::BIGINT AS new_works, (row_number() OVER (PARTITION BY lineage_id ORDER BY q_idx) - 1)::INTEGER AS place FROM grid LEFT JOIN sparse USING (lineage_id, q_idx))"""


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with every third quarter of a lineage left out, so that grids have gaps to fill."""
    return B.series(spark, sf_dir).where((F.col("lineage_id") + F.col("q_idx")) % 3 != 0)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.densify(_sparse(spark, sf_dir), ["lineage_id"])


@query(SPARSE + "SELECT * FROM dense")
def d065_dense_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@query(SPARSE + """
SELECT lineage_id, q_idx, round(avg(new_works) OVER y, 6) AS year_mean, (sum(new_works) OVER y)::BIGINT AS year_sum, (sum(new_works) OVER o)::BIGINT AS cumulative, round(ln(1 + sum(new_works) OVER o), 6) AS log_cumulative,
  new_works - lag(new_works, 4) OVER o AS yoy_delta, round(CASE WHEN lag(new_works, 4) OVER o > 0 THEN (new_works - lag(new_works, 4) OVER o) / (lag(new_works, 4) OVER o)::DOUBLE END, 6) AS yoy_pct
FROM dense WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx), y AS (PARTITION BY lineage_id ORDER BY q_idx ROWS 3 PRECEDING)""")
def d066_seasonal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series.seasonal_context(_dense(spark, sf_dir), ["lineage_id"])
    return s.select("lineage_id", "q_idx", "year_sum", "cumulative", "yoy_delta", *rounded(["year_mean", "log_cumulative", "yoy_pct"]))


@query(with_(SERIES) + """, d AS (SELECT lineage_id, q_idx, new_works, COALESCE(new_works - lag(new_works) OVER o, 0) AS delta, COALESCE(new_works - lag(new_works, 4) OVER o, 0) AS yoy_delta,
  COALESCE(new_works / nullif(lag(new_works, 4) OVER o, 0)::DOUBLE, 0) AS yoy_ratio, avg(new_works) OVER (o ROWS 1 PRECEDING) AS roll_mean_2, avg(new_works) OVER (o ROWS 3 PRECEDING) AS roll_mean_4,
  COALESCE(stddev_samp(new_works) OVER (o ROWS 3 PRECEDING), 0) AS roll_std_4, (sum(new_works) OVER o)::BIGINT AS cumulative FROM series WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx))
SELECT lineage_id, q_idx, new_works, delta, yoy_delta, cumulative, COALESCE(delta - lag(delta) OVER (PARTITION BY lineage_id ORDER BY q_idx), 0) AS acceleration,
  round(yoy_ratio, 6) AS yoy_ratio, round(roll_mean_2, 6) AS roll_mean_2, round(roll_mean_4, 6) AS roll_mean_4, round(roll_std_4, 6) AS roll_std_4 FROM d""".replace("(o ROWS", "(PARTITION BY lineage_id ORDER BY q_idx ROWS"))
def d067_growth_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = series.growth_features(B.series(spark, sf_dir), ["lineage_id"])
    return g.select("lineage_id", "q_idx", "new_works", "delta", "yoy_delta", "cumulative", "acceleration", *rounded(["yoy_ratio", "roll_mean_2", "roll_mean_4", "roll_std_4"]))


EVENTS = "marks AS (SELECT n_nationkey AS event_id, s_suppkey AS lineage_id, (7982 + n_nationkey % 24)::INTEGER AS event_q FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 1)"


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for two of three suppliers, in a quarter that its nation gives."""
    return B.table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 1").select(F.col("s_nationkey").alias("event_id"), F.col("s_suppkey").alias("lineage_id"), (F.lit(7982) + F.col("s_nationkey") % 24).cast("int").alias("event_q"))


@query(with_(SERIES, EVENTS) + """
SELECT s.lineage_id, s.q_idx, max(e.event_q) AS last_event_q, s.q_idx - max(e.event_q) AS quarters_since FROM series s LEFT JOIN marks e ON s.lineage_id = e.lineage_id AND e.event_q < s.q_idx GROUP BY s.lineage_id, s.q_idx""")
def d069_milestone_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.last_before(B.series(spark, sf_dir), _marks(spark, sf_dir), ["lineage_id"])


@query(SPARSE + """, n AS (SELECT *, row_number() OVER o AS r FROM dense WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)),
l AS (SELECT *, max(CASE WHEN new_works > 0 THEN r END) OVER (PARTITION BY lineage_id ORDER BY q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ FROM n)
SELECT lineage_id, q_idx, (r - 1 - COALESCE(last_, 0))::INTEGER AS streak, CASE WHEN new_works > 0 THEN new_works * greatest(r - 1 - COALESCE(last_, 0), 1) ELSE 0 END::BIGINT AS awakening FROM l""")
def d070_dormancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dormancy(_dense(spark, sf_dir), ["lineage_id"]).select("lineage_id", "q_idx", "streak", "awakening")


@query(with_(SERIES) + """, m AS (SELECT q_idx, avg(new_works) AS value FROM series GROUP BY 1)
SELECT q_idx, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS z, round(COALESCE(value - lag(value) OVER o, 0), 6) AS qoq, round(value, 6) AS roll_1, round(avg(value) OVER (ORDER BY q_idx ROWS 1 PRECEDING), 6) AS roll_2,
  round(avg(value) OVER y, 6) AS roll_4, round(max(value) OVER y - value, 6) AS below_max, round(value - min(value) OVER y, 6) AS above_min FROM m WINDOW o AS (ORDER BY q_idx), y AS (ORDER BY q_idx ROWS 3 PRECEDING)""")
def d075_context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = series.context_features(B.series(spark, sf_dir).groupBy("q_idx").agg(F.avg("new_works").alias("value")))
    return c.select("q_idx", *rounded(["z", "qoq", "roll_1", "roll_2", "roll_4", "below_max", "above_min"]))


@query(with_(SERIES) + """, f AS (SELECT q_idx, sum(new_works) AS t, quantile_cont(new_works, 0.75) AS p, avg(new_works) AS m FROM series GROUP BY 1)
SELECT lineage_id, q_idx, round(new_works / t::DOUBLE, 6) AS field_share, round(new_works / p, 6) AS p75_ratio, round(new_works - m, 6) AS above_mean FROM series JOIN f USING (q_idx)""")
def d076_field_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.field_relative(B.series(spark, sf_dir), ["lineage_id"]).select("lineage_id", "q_idx", *rounded(["field_share", "p75_ratio", "above_mean"]))


ONSETS = """, sm AS (SELECT lineage_id, q_idx, avg(new_works) OVER (PARTITION BY lineage_id ORDER BY q_idx ROWS 2 PRECEDING) AS s, row_number() OVER (PARTITION BY lineage_id ORDER BY q_idx) - 1 AS place FROM series),
gr AS (SELECT *, (s - lag(s) OVER o) / greatest(lag(s) OVER o, 1.0) AS g FROM sm WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)),
ah AS (SELECT *, min(g) OVER a AS least, count(g) OVER a AS n FROM gr WINDOW a AS (PARTITION BY lineage_id ORDER BY q_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
hit AS (SELECT lineage_id, min(q_idx) AS onset_q, arg_min(s, q_idx) AS s, arg_min(g, q_idx) AS g, arg_min(place, q_idx) AS place FROM ah WHERE place >= 1 AND s >= 3 AND g >= 0.05 AND least > 0 AND n = 3 GROUP BY 1),
ons AS (SELECT l.lineage_id, l.n, h.onset_q, h.s, h.g, h.place FROM (SELECT lineage_id, count(*) AS n FROM series GROUP BY 1) l LEFT JOIN hit h USING (lineage_id))"""


@query(with_(SERIES) + ONSETS + """
SELECT lineage_id, CASE WHEN n < 6 THEN 'insufficient_history' WHEN onset_q IS NOT NULL THEN 'detected' ELSE 'no_onset' END AS reason, CASE WHEN n >= 6 THEN onset_q END AS onset_q,
  round(CASE WHEN n >= 6 THEN s END, 6) AS smoothed, round(CASE WHEN n >= 6 THEN g END, 6) AS growth, CASE WHEN n >= 6 AND onset_q IS NOT NULL THEN place <= 1 END AS early FROM ons""")
def d089_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.onsets(B.series(spark, sf_dir), ["lineage_id"], growth=0.05)
    return o.select("lineage_id", "reason", "onset_q", "early", *rounded(["smoothed", "growth"]))


MATURE = """, ms AS (SELECT lineage_id, q_idx, avg(new_works) OVER (PARTITION BY lineage_id ORDER BY q_idx ROWS 2 PRECEDING) AS s, row_number() OVER (PARTITION BY lineage_id ORDER BY q_idx) - 1 AS place FROM series),
mg AS (SELECT *, (s - lag(s) OVER o) / greatest(lag(s) OVER o, 1.0) AS g FROM ms WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)),
mp AS (SELECT lineage_id, min(place) AS peak, max(last_) AS last_ FROM (SELECT *, max(s) OVER (PARTITION BY lineage_id) AS top, max(place) OVER (PARTITION BY lineage_id) AS last_ FROM mg) WHERE s = top GROUP BY 1),
mk AS (SELECT *, count(*) OVER a AS n, min((s < 2)::INT) OVER a AS dorm, min(COALESCE(g < -0.1, false)::INT) OVER a AS sen, min(COALESCE(abs(g) < 0.1 AND s >= 5, false)::INT) OVER a AS sat
  FROM mg WINDOW a AS (PARTITION BY lineage_id ORDER BY q_idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
mk2 AS (SELECT k.*, last_, CASE WHEN n = 4 AND dorm = 1 THEN 'dormancy' WHEN n = 4 AND sen = 1 THEN 'senescence' WHEN n = 4 AND sat = 1 THEN 'saturation' END AS kind FROM mk k JOIN mp p ON k.lineage_id = p.lineage_id AND k.place >= p.peak),
mature AS (SELECT lineage_id, min(q_idx) FILTER (kind IS NOT NULL) AS maturation_q, arg_min(kind, q_idx) FILTER (kind IS NOT NULL) AS kind, arg_min(place, q_idx) FILTER (kind IS NOT NULL) + 4 > max(last_) AS late FROM mk2 GROUP BY 1)"""


@query(with_(SERIES) + MATURE + "SELECT lineage_id, maturation_q, kind, late FROM mature")
def d090_maturations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.maturations(B.series(spark, sf_dir), ["lineage_id"])


@query(with_(SERIES) + ONSETS + MATURE + """
SELECT s.lineage_id, s.q_idx, CASE WHEN o.onset_q IS NULL THEN 'never_grew' WHEN s.q_idx < o.onset_q THEN 'pre_onset' WHEN s.q_idx >= m.maturation_q THEN 'post_maturation' ELSE 'growth' END AS stage,
  CASE WHEN s.q_idx >= o.onset_q THEN s.q_idx - o.onset_q END AS since_onset FROM series s LEFT JOIN ons o USING (lineage_id) LEFT JOIN mature m USING (lineage_id)""")
def d077_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir)
    return series.lifecycle(s, D.onsets(s, ["lineage_id"], growth=0.05), D.maturations(s, ["lineage_id"]), ["lineage_id"])


@query(with_(SERIES, MAPPING) + """, named AS (SELECT front, lineage_id, q_idx, new_works FROM series JOIN mapping USING (lineage_id)),
grid AS (SELECT front, unnest(range((SELECT min(q_idx) FROM named), (SELECT max(q_idx) FROM named) + 1))::INTEGER AS q_idx FROM (SELECT DISTINCT front FROM named)),
f AS (SELECT front, q_idx, sum(new_works)::BIGINT AS n FROM named GROUP BY ALL), a AS (SELECT front, q_idx, count(*) AS arrived FROM (SELECT front, lineage_id, min(q_idx) AS q_idx FROM named GROUP BY ALL) GROUP BY ALL),
d AS (SELECT front, q_idx, COALESCE(n, 0) AS new_works, COALESCE(arrived, 0) AS arrived FROM grid LEFT JOIN f USING (front, q_idx) LEFT JOIN a USING (front, q_idx)),
x AS (SELECT *, COALESCE((new_works - lag(new_works) OVER o) / greatest(lag(new_works) OVER o, 1)::DOUBLE, 0) AS growth, avg(new_works) OVER y AS roll_mean_4, stddev_pop(new_works) OVER y AS roll_std_4,
  COALESCE((new_works - lag(new_works, 4) OVER o) / greatest(lag(new_works, 4) OVER o, 1)::DOUBLE, 0) AS yoy, (sum(arrived) OVER o)::BIGINT AS lineages_so_far
  FROM d WINDOW o AS (PARTITION BY front ORDER BY q_idx), y AS (PARTITION BY front ORDER BY q_idx ROWS 3 PRECEDING))
SELECT front, q_idx, new_works, lineages_so_far, round(growth, 6) AS growth, round(roll_mean_4, 6) AS roll_mean_4, round(roll_std_4, 6) AS roll_std_4, round(yoy, 6) AS yoy,
  round(COALESCE(growth - lag(growth) OVER (PARTITION BY front ORDER BY q_idx), 0), 6) AS acceleration FROM x""")
def d083_front_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = series.front_series(B.series(spark, sf_dir), B.mapping(spark, sf_dir))
    return f.select("front", "q_idx", "new_works", "lineages_so_far", *rounded(["growth", "roll_mean_4", "roll_std_4", "yoy", "acceleration"]))


@query(with_(SERIES) + """, f AS (SELECT *, COALESCE((new_works < lag(new_works) OVER o)::INT, 0) AS falling FROM series WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)),
i AS (SELECT *, sum(1 - falling) OVER (PARTITION BY lineage_id ORDER BY q_idx) AS island FROM f)
SELECT lineage_id, q_idx, (sum(falling) OVER (PARTITION BY lineage_id, island ORDER BY q_idx))::BIGINT AS decline_streak FROM i""")
def d083_decline_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.decline_streaks(B.series(spark, sf_dir), ["lineage_id"])


@query(with_(SERIES) + """SELECT q_idx, round(sum(lineage_id % 7 * new_works) / sum(new_works)::DOUBLE, 6) AS weighted_mean, round(avg(lineage_id % 7), 6) AS simple_mean, round(median(lineage_id % 7), 6) AS median FROM series GROUP BY 1""")
def d084_lineage_to_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = series.field_from_lineages(B.series(spark, sf_dir), F.col("lineage_id") % 7, F.col("new_works"))
    return f.select("q_idx", *rounded(["weighted_mean", "simple_mean", "median"]))


@query(with_(SERIES) + """, l AS (SELECT 'new_works' AS feature, new_works::DOUBLE AS v FROM series UNION ALL SELECT 'q_idx_mod', (q_idx % 5)::DOUBLE FROM series),
s AS (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS m, stddev_pop(v) AS sd FROM l GROUP BY 1)
SELECT feature, count(*) AS rows, count(*) FILTER (v IS NULL) AS nulls, round(avg((v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1))::INT), 6) AS iqr_share, round(avg((abs((v - m) / sd) > 5)::INT), 6) AS z_share FROM l JOIN s USING (feature) GROUP BY 1""")
def d087_feature_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir).select("new_works", (F.col("q_idx") % 5).alias("q_idx_mod"))
    return series.outlier_report(s, ["new_works", "q_idx_mod"]).select("feature", "rows", "nulls", *rounded(["iqr_share", "z_share"]))


BACKGROUND = FRONTS + """, ends AS (SELECT min(q_idx) AS lo, max(q_idx) AS hi FROM fronts),
dense AS (SELECT g.front, g.q_idx, COALESCE(f.count, 0)::BIGINT AS count FROM (SELECT front, unnest(range(lo, hi + 1))::INTEGER AS q_idx FROM (SELECT DISTINCT front FROM fronts), ends) g LEFT JOIN fronts f USING (front, q_idx)),
h AS (SELECT *, count(count) OVER p AS history, avg(count) OVER p AS mu, var_samp(count) OVER p AS variance FROM dense WINDOW p AS (PARTITION BY front ORDER BY q_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
bg AS (SELECT *, CASE WHEN mu < 1e-9 THEN 'Zero' WHEN variance <= mu THEN 'Poisson' ELSE 'NB' END AS model FROM h WHERE history >= 8)"""


@query(BACKGROUND + "SELECT front, q_idx, count, round(mu, 6) AS mu, round(variance, 6) AS variance, model, round(CASE WHEN model = 'NB' THEN mu * mu / (variance - mu) END, 4) AS k FROM bg")
def d088_burst_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.burst_background(_fronts(spark, sf_dir), ["front"])
    return b.select("front", "q_idx", "count", "model", *rounded(["mu", "variance"]), F.round("k", 4).alias("k"))


@query(BACKGROUND + """, t AS (SELECT *, greatest(CASE model WHEN 'Zero' THEN CASE WHEN count > 0 THEN 0 ELSE 1 END
  WHEN 'Poisson' THEN 1 - COALESCE(list_sum(list_transform(range(count), lambda j: exp(-mu + j * ln(mu) - lgamma(j + 1)))), 0)
  ELSE 1 - COALESCE(list_sum(list_transform(range(count), lambda j: exp(lgamma(j + mu * mu / (variance - mu)) - lgamma(mu * mu / (variance - mu)) - lgamma(j + 1) + mu * mu / (variance - mu) * ln(mu / variance) + j * ln(1 - mu / variance)))), 0) END, 0)::DOUBLE AS p FROM bg),
n AS (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY p, front) AS r, count(*) OVER (PARTITION BY q_idx) AS m FROM t),
q AS (SELECT *, min(p * m / r) OVER (PARTITION BY q_idx ORDER BY p, front ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM n)
SELECT front, q_idx, count, model, round(p, 8) AS p_value, round(q, 7) AS q_value, round(count / mu, 6) AS rate_ratio, q <= 0.1 AS alert FROM q WHERE model <> 'Zero'""")
def d088_burst_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = D.burst_alerts(_fronts(spark, sf_dir), ["front"])
    return a.select("front", "q_idx", "count", "model", F.round("p_value", 8).alias("p_value"), F.round("q_value", 7).alias("q_value"), F.round("rate_ratio", 6).alias("rate_ratio"), "alert")


@query()
def d068_causal_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.causal_logistic(_fronts(spark, sf_dir).withColumnRenamed("count", "new_works"), ["front"])


@query()
def d091_retrospective_inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.retrospective_inflections(B.series(spark, sf_dir), ["lineage_id"])


@query(with_(SERIES).replace("WITH", "WITH RECURSIVE") + """, o AS (SELECT lineage_id, q_idx, new_works::DOUBLE AS x, row_number() OVER (PARTITION BY lineage_id ORDER BY q_idx) AS t FROM series),
f AS (SELECT DISTINCT lineage_id, 0::BIGINT AS t, 0::INTEGER AS q_idx, [1.0::DOUBLE] AS m, [1.0::DOUBLE] AS a, [0.1::DOUBLE] AS b FROM o
  UNION ALL SELECT lineage_id, t, q_idx, list_transform(m, lambda v: v / list_sum(m)), a, b FROM (
    SELECT lineage_id, t, q_idx, list_concat([list_sum(g) * 0.02], list_transform(g, lambda v: v * 0.98))[1:41] AS m, list_concat([1.0::DOUBLE], list_transform(a, lambda v: v + x))[1:41] AS a, list_concat([0.1::DOUBLE], list_transform(b, lambda v: v + 1))[1:41] AS b FROM (
      SELECT o.lineage_id, o.t, o.q_idx, o.x, a, b,
        list_transform(range(1, len(m) + 1), lambda i: m[i] * exp(lgamma(o.x + a[i]) - lgamma(a[i]) - lgamma(o.x + 1) + a[i] * ln(b[i] / (b[i] + 1)) + o.x * ln(1 / (b[i] + 1)))) AS g
      FROM f JOIN o ON o.lineage_id = f.lineage_id AND o.t = f.t + 1)))
SELECT lineage_id, q_idx, round(list_sum(m[1:4]), 6) AS changepoint_prob, list_sum(m[1:4]) > 0.5 AS alert, (list_position(m, list_max(m)) - 1)::INTEGER AS run_length FROM f WHERE t > 0""")
def d092_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.changepoint_probabilities(B.series(spark, sf_dir), ["lineage_id"]).withColumn("changepoint_prob", F.round("changepoint_prob", 6))


@query(with_(SERIES).replace("WITH", "WITH RECURSIVE") + """, o AS (SELECT lineage_id, q_idx, new_works::DOUBLE AS x, row_number() OVER (PARTITION BY lineage_id ORDER BY q_idx) AS t FROM series),
r AS (SELECT lineage_id, greatest(avg(x), 1e-9) AS mean, count(*) AS n FROM o GROUP BY 1), e AS (SELECT o.lineage_id, o.t, n, list_transform([1.0, 2.0, 4.0], lambda k: mean * k - x * ln(mean * k)) AS em FROM o JOIN r USING (lineage_id)),
f AS (SELECT lineage_id, t, n, list_transform([1, 2, 3], lambda i: em[i] + (i - 1)) AS cost, [[0], [1], [2]] AS paths FROM e WHERE t = 1
  UNION ALL SELECT lineage_id, t, n, list_transform([1, 2, 3], lambda j: list_min(th[j]) + em[j]), list_transform([1, 2, 3], lambda j: list_append(paths[list_position(th[j], list_min(th[j]))], j - 1)) FROM (
    SELECT e.lineage_id, e.t, e.n, em, paths, list_transform([1, 2, 3], lambda j: list_transform([1, 2, 3], lambda i: cost[i] + abs(i - j))) AS th FROM f JOIN e ON e.lineage_id = f.lineage_id AND e.t = f.t + 1)),
b AS (SELECT lineage_id, paths[list_position(cost, list_min(cost))] AS path FROM f WHERE t = n), s AS (SELECT o.lineage_id, q_idx, t, path[t] AS state FROM o JOIN b USING (lineage_id)),
c AS (SELECT *, COALESCE(((state > 0) <> lag(state > 0) OVER (PARTITION BY lineage_id ORDER BY t))::INT, 0) AS turn FROM s), i AS (SELECT *, sum(turn) OVER (PARTITION BY lineage_id ORDER BY t) AS run FROM c)
SELECT lineage_id, q_idx, state::INTEGER AS state, state > 0 AND count(*) OVER (PARTITION BY lineage_id, run) BETWEEN 3 AND 8 AS burst FROM i""")
def d093_burst_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.burst_periods(B.series(spark, sf_dir), ["lineage_id"])


@query(with_(SERIES) + """, x AS (SELECT *, sum(new_works) OVER o AS cumulative, COALESCE(new_works - lag(new_works) OVER o, 0) AS delta FROM series WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)),
a AS (SELECT *, (delta - COALESCE(lag(delta) OVER (PARTITION BY lineage_id ORDER BY q_idx), 0))::DOUBLE AS accel FROM x),
c AS (SELECT quantile_cont(cumulative, 0.33) AS c33, quantile_cont(cumulative, 0.67) AS c67, avg(accel) AS gm, stddev_pop(accel) AS gs FROM a),
t AS (SELECT a.*, gm, gs, CASE WHEN cumulative <= c33 THEN 0 WHEN cumulative <= c67 THEN 1 ELSE 2 END AS tercile FROM a, c),
g AS (SELECT tercile, count(*) AS tn, avg(accel) AS tm, stddev_samp(accel) AS ts FROM t GROUP BY 1),
z AS (SELECT t.*, COALESCE((accel - CASE WHEN tn >= 100 THEN tm ELSE gm END) / nullif(CASE WHEN tn >= 100 THEN ts ELSE gs END, 0), 0) AS z FROM t JOIN g USING (tercile)),
k AS (SELECT quantile_cont(z, 0.9) AS cut FROM z)
SELECT lineage_id, q_idx, round(z, 5) AS z, z >= cut AND cumulative >= 10 AS single, (sum((z >= cut)::INT) OVER (PARTITION BY lineage_id ORDER BY q_idx ROWS 2 PRECEDING)) >= 2 AND cumulative >= 10 AS momentum FROM z, k""")
def d095_size_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.size_heuristics(B.series(spark, sf_dir), ["lineage_id"]).withColumn("z", F.round("z", 5))


@query(with_(SERIES) + """, g AS (SELECT lineage_id, q_idx, new_works % 10 / 10.0 AS p, COALESCE((new_works - lag(new_works) OVER o) / greatest(lag(new_works) OVER o, 1)::DOUBLE, 0) AS g FROM series WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx))
SELECT lineage_id, q_idx, p >= 0.3 AS changepoint_only, g >= 0.3 AS growth_only, max((p >= 0.3)::INT) OVER (PARTITION BY lineage_id ORDER BY q_idx ROWS 2 PRECEDING) = 1 AND g >= 0.3 AS sequential,
  p >= 0.3 AND g >= 0.3 AS conjunctive, p >= 0.3 OR g >= 0.3 AS disjunctive, 0.6::DOUBLE * p + 0.4::DOUBLE * least(greatest(g, 0), 1) >= 0.3 AS weighted FROM g""")
def d096_hybrid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir)
    g = D.growth_alerts(s, ["lineage_id"]).join(s, ["lineage_id", "q_idx"]).withColumn("changepoint_prob", F.col("new_works") % 10 / F.lit(10.0))
    return D.hybrid_rules(g, ["lineage_id"])


@query(with_(SERIES) + """SELECT lineage_id, q_idx, round(COALESCE((new_works - lag(new_works) OVER o) / greatest(lag(new_works) OVER o, 1)::DOUBLE, 0), 6) AS growth,
  COALESCE((new_works - lag(new_works) OVER o) / greatest(lag(new_works) OVER o, 1)::DOUBLE, 0) >= 0.5 AS alert FROM series WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)""")
def d101_growth_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.growth_alerts(B.series(spark, sf_dir), ["lineage_id"]).withColumn("growth", F.round("growth", 6))


@query(with_(SERIES) + "SELECT lineage_id, q_idx, ('0x' || substr(md5('42|' || lineage_id || '|' || q_idx), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.05 AS alert FROM series")
def d101_random_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.random_alerts(B.series(spark, sf_dir), ["lineage_id"])


@query(with_(SERIES) + """, p AS (SELECT lineage_id, q_idx, (new_works % 11) / 10.0::DOUBLE AS probability FROM series),
m AS (SELECT *, avg(probability) OVER w AS mean, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY lineage_id ORDER BY q_idx ROWS 1 PRECEDING))
SELECT lineage_id, q_idx, probability, probability >= 0.5 AND n = 2 AND mean >= 0.5 AS persistent FROM m""")
def d098_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.series(spark, sf_dir).select("lineage_id", "q_idx", (F.col("new_works") % 11 / F.lit(10.0)).alias("probability"))
    return D.persistent(p, ["lineage_id"], threshold=0.5)


@query(with_(SERIES, EVENTS) + """SELECT s.lineage_id, s.q_idx, s.new_works, max((e.event_q IS NOT NULL)::INT)::INTEGER AS is_onset
FROM series s LEFT JOIN marks e ON s.lineage_id = e.lineage_id AND s.q_idx BETWEEN e.event_q + 2 AND e.event_q + 8 GROUP BY ALL""")
def d099_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.label_windows(B.series(spark, sf_dir), _marks(spark, sf_dir), ["lineage_id"])


@query(BACKGROUND + """, al AS (SELECT *, count >= mu * 1.05 AS alert, count / mu AS rate_ratio FROM bg)
SELECT q_idx, count(DISTINCT front) AS n_fronts, string_agg(front, '|' ORDER BY front) AS fronts, round(max(rate_ratio), 6) AS max_ratio, round(sum(count - mu), 4) AS excess, sum(count)::BIGINT AS total,
  count(DISTINCT front) >= 2 OR max(rate_ratio) >= 1.5 AS field_alert FROM al WHERE alert GROUP BY 1""")
def d100_alerts_to_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.burst_background(_fronts(spark, sf_dir), ["front"])
    a = b.withColumns({"alert": F.col("count") >= F.col("mu") * 1.05, "rate_ratio": F.col("count") / F.col("mu"), "q_value": F.lit(0.0)})
    f = D.alerts_to_field(a)
    return f.select("q_idx", "n_fronts", "fronts", F.round("max_ratio", 6).alias("max_ratio"), F.round("excess", 4).alias("excess"), "total", "field_alert")


@query(with_(SERIES, EVENTS) + """, j AS (SELECT s.lineage_id, s.q_idx, e.event_id, s.q_idx - e.event_q AS lag, row_number() OVER (PARTITION BY s.lineage_id, s.q_idx ORDER BY abs(s.q_idx - e.event_q), e.event_q, e.event_id) AS n FROM series s LEFT JOIN marks e USING (lineage_id))
SELECT lineage_id, q_idx, event_id, lag, CASE WHEN lag IS NULL THEN 'no_milestone' WHEN abs(lag) < 4 THEN '<4q' WHEN abs(lag) < 8 THEN '4-8q' WHEN abs(lag) < 12 THEN '8-12q' ELSE '>=12q' END AS bucket FROM j WHERE n = 1""")
def d112_nearest_milestone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.nearest_event(B.series(spark, sf_dir), _marks(spark, sf_dir), ["lineage_id"])


@query(with_(SERIES) + """, g AS (SELECT lineage_id, q_idx, COALESCE((new_works - lag(new_works) OVER o) / (lag(new_works) OVER o + 1)::DOUBLE, 0) AS growth FROM series WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)),
a AS (SELECT *, COALESCE(growth - lag(growth) OVER o, 0) AS acceleration, COALESCE(stddev_samp(growth) OVER (PARTITION BY lineage_id ORDER BY q_idx ROWS 2 PRECEDING), 0) AS volatility FROM g WINDOW o AS (PARTITION BY lineage_id ORDER BY q_idx)),
c AS (SELECT quantile_cont(acceleration, 0.9) AS ca, quantile_cont(volatility, 0.9) AS cv FROM a)
SELECT lineage_id, q_idx, round(growth, 6) AS growth, round(acceleration, 6) AS acceleration, round(volatility, 6) AS volatility, acceleration > ca AND volatility > cv AS flag FROM a, c""")
def d123_two_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.two_signals(B.series(spark, sf_dir), ["lineage_id"]).select("lineage_id", "q_idx", *rounded(["growth", "acceleration", "volatility"]), "flag")


@query()
def d094_vector_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label's quarterly mean vectors, which turn to other labels' vectors for the second half of the quarters."""
    v = B.vectors(spark, sf_dir).withColumn("q_idx", (F.col("vec_id") % 24).cast("int"))
    v = v.withColumn("label", F.when(F.col("q_idx") >= 12, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return D.vector_changepoints(signals.weighted_mean_vector(v, ["label", "q_idx"]), ["label"], penalty=0.5)


@query()
def d125_parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of lookbacks, least counts and levels, and random settings, against each front's quarters of strongest growth."""
    f = _fronts(spark, sf_dir)
    grown = D.growth_alerts(f, ["front"], "count", theta=0.1).where("alert").select("front", F.col("q_idx").alias("event_q"))
    settings = [(lookback, least, alpha) for lookback in (8, 12, 16) for least in (0, 1, 3) for alpha in (0.05, 0.1, 0.2)]
    s = D.burst_parameter_sweep(f, ["front"], [*settings, *D.drawn_settings(6)], grown)
    return s.select("lookback", "min_count", "alpha", "tests", "alerts", "groups", *rounded(["precision", "recall", "f1", "lead"]))


@query()
def d126_changepoint_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir)
    known = D.onsets(s, ["lineage_id"], growth=0.05).where("onset_q IS NOT NULL")
    c = D.changepoint_calibration(s, ["lineage_id"], known)
    return c.select("window", "onsets", *rounded(["hazard", "threshold", "shape", "rate", "mean_p", "max_p", "alert_rate", "onset_rate", "mean_lag", "false_alarm_rate"]))
