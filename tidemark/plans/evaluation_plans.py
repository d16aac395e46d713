"""Queries on evaluation, calibration and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions.numeric import rounded
from tidemark.operators import evaluation as E
from tidemark.operators import learning
from tidemark.plans import bindings as B
from tidemark.plans.bindings import SCORES, SERIES, with_
from tidemark.plans.series_plans import EVENTS, _marks

ALERTS = "al AS (SELECT lineage_id, q_idx FROM series WHERE (lineage_id * 7 + q_idx * 3) % 19 = 0)"
TRUTH = "tr AS (SELECT lineage_id, min(event_q) AS onset_q FROM marks GROUP BY 1)"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.series(spark, sf_dir).where((F.col("lineage_id") * 7 + F.col("q_idx") * 3) % 19 == 0).select("lineage_id", "q_idx")


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).groupBy("lineage_id").agg(F.min("event_q").alias("onset_q"))


@query(with_(SERIES, EVENTS, ALERTS, TRUTH) + """, j AS (SELECT al.lineage_id, q_idx, onset_q, COALESCE(q_idx BETWEEN onset_q AND onset_q + 8, false) AS inside FROM al LEFT JOIN tr USING (lineage_id)),
k AS (SELECT lineage_id, min(q_idx - onset_q) FILTER (inside) AS delay, count(*) FILTER (NOT inside) AS fa FROM j GROUP BY 1), e AS (SELECT onset_q, delay, fa FROM tr FULL JOIN k USING (lineage_id)),
s AS (SELECT COALESCE(sum(CASE WHEN onset_q IS NOT NULL AND delay IS NOT NULL THEN 2 / (1 + exp(5 * (delay / 8.0::DOUBLE - 1))) - 1 END), 0) AS hits, sum(fa)::BIGINT AS false_alerts, count(*) FILTER (onset_q IS NOT NULL AND delay IS NULL) AS missed,
  count(onset_q) AS onsets, avg(CASE WHEN onset_q IS NOT NULL THEN delay END) AS mean_delay FROM e),
p AS (SELECT * FROM (VALUES ('standard', 1.0::DOUBLE, 0.11::DOUBLE, 1.0::DOUBLE), ('low_fp', 1.0, 0.22, 1.0), ('low_fn', 1.0, 0.11, 2.0)) v(profile, tp, fp, fn)),
r AS (SELECT *, tp * hits - fp * false_alerts - fn * missed AS raw, tp * (2 / (1 + exp(-5.0::DOUBLE)) - 1) * onsets AS perfect, -fn * onsets AS nul FROM s, p)
SELECT profile, onsets, missed, false_alerts, round(mean_delay, 6) AS mean_delay, round(raw, 6) AS raw, round(100 * (raw - nul) / (perfect - nul), 6) AS normalised FROM r""")
def d102_timeliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.timeliness_scores(_alerts(spark, sf_dir), _truth(spark, sf_dir))
    return t.select("profile", "onsets", "missed", "false_alerts", *rounded(["mean_delay", "raw", "normalised"]))


@query(with_(SERIES, EVENTS, ALERTS, TRUTH) + """, l AS (SELECT (SELECT min(q_idx) FROM al WHERE al.lineage_id = tr.lineage_id) - onset_q AS lag FROM tr)
SELECT count(*) AS onsets, round(count(lag) / count(*)::DOUBLE, 6) AS coverage, round(median(lag), 6) AS median_lag, round(avg(lag), 6) AS mean_lag, round(avg((lag <= 0)::INT), 6) AS by_0, round(avg((lag <= 2)::INT), 6) AS by_2 FROM l""")
def d103_detection_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.detection_lags(_alerts(spark, sf_dir), _truth(spark, sf_dir)).select("onsets", *rounded(["coverage", "median_lag", "mean_lag", "by_0", "by_2"]))


SWEEP = with_(SCORES) + """, c AS (SELECT t AS threshold, count(*) FILTER (probability >= t AND outcome = 1) AS tp, count(*) FILTER (probability >= t AND outcome <> 1) AS fp, count(*) FILTER (probability < t AND outcome = 1) AS fn,
  count(*) FILTER (probability < t AND outcome <> 1) AS tn FROM scores, (SELECT unnest([0.1::DOUBLE, 0.3, 0.5, 0.7, 0.9]) AS t) GROUP BY 1),
sw AS (SELECT *, COALESCE(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, COALESCE(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, COALESCE(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, COALESCE(5 * tp / nullif(5 * tp + fp + 4 * fn, 0)::DOUBLE, 0) AS f2,
  COALESCE((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM c)"""
_RATES = ["precision", "recall", "f1", "f2", "mcc"]
_RATES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _RATES)


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threshold_sweep(B.scores(spark, sf_dir), [0.1, 0.3, 0.5, 0.7, 0.9])


@query(SWEEP + f"SELECT threshold, tp, fp, fn, tn, {_RATES_SQL} FROM sw")
def d104_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir).select("threshold", "tp", "fp", "fn", "tn", *rounded(_RATES))


@query(SWEEP + "SELECT threshold, round(f1, 6) AS f1 FROM sw ORDER BY f1 DESC, threshold LIMIT 1")
def d104_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_threshold(_sweep(spark, sf_dir)).select("threshold", F.round("f1", 6).alias("f1"))


@query(SWEEP + "SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sw ORDER BY precision >= 0.8 DESC, recall DESC, threshold LIMIT 1")
def d124_precision_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_threshold(_sweep(spark, sf_dir), 0.8).select("threshold", *rounded(["precision", "recall"]))


@query(with_(SCORES) + """, b AS (SELECT probability, sum(outcome)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scores GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS p, sum(n) OVER () AS r FROM b WINDOW w AS (ORDER BY probability DESC))
SELECT max(r)::BIGINT AS rows, max(p)::BIGINT AS positives, round(sum(pos / p * tp / seen), 6) AS average_precision, round(sum((n - pos) * (tp - pos / 2)) / max(p * (r - p)), 6) AS roc_auc FROM c""")
def d105_ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ranking_quality(B.scores(spark, sf_dir)).select("rows", "positives", *rounded(["average_precision", "roc_auc"]))


HISTORY = with_(SERIES) + """, hist AS (SELECT lineage_id, (q_idx // 4) || 'Q' || (q_idx % 4 + 1) AS quarter_predicted, (new_works % 100) / 100.0::DOUBLE AS probability, CASE WHEN lineage_id % 4 = 0 THEN 0 ELSE -1 END::INTEGER AS actual_outcome,
  CASE WHEN lineage_id % 4 = 0 THEN 'explicit' END AS outcome_source FROM series WHERE q_idx % 2 = 0),
lab AS (SELECT lineage_id, (q_idx // 4) || 'Q' || (q_idx % 4 + 1) AS quarter, (new_works % 2)::INTEGER AS is_onset FROM series WHERE q_idx % 4 = 0 AND lineage_id % 3 <> 2)"""


def _quarter() -> F.Column:
    q = F.col("q_idx")
    return F.concat(F.floor(q / 4).cast("int"), F.lit("Q"), q % 4 + 1)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.series(spark, sf_dir).where("q_idx % 2 = 0")
    known = F.col("lineage_id") % 4 == 0
    return s.select("lineage_id", _quarter().alias("quarter_predicted"), (F.col("new_works") % 100 / F.lit(100.0)).alias("probability"), F.when(known, 0).otherwise(-1).alias("actual_outcome"), F.when(known, "explicit").alias("outcome_source"))


@query(HISTORY + """SELECT h.lineage_id, h.quarter_predicted, h.probability, CASE WHEN actual_outcome = -1 AND l.is_onset IS NOT NULL THEN l.is_onset WHEN actual_outcome = -1 AND s.lineage_id IS NOT NULL THEN 0 ELSE actual_outcome END AS actual_outcome,
  CASE WHEN actual_outcome = -1 AND l.is_onset IS NOT NULL THEN 'explicit' WHEN actual_outcome = -1 AND s.lineage_id IS NOT NULL THEN 'implicit' ELSE outcome_source END AS outcome_source
FROM hist h LEFT JOIN lab l ON l.lineage_id = h.lineage_id AND l.quarter = h.quarter_predicted LEFT JOIN (SELECT DISTINCT lineage_id FROM lab) s ON s.lineage_id = h.lineage_id""")
def d106_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = B.series(spark, sf_dir).where("q_idx % 4 = 0 AND lineage_id % 3 <> 2").select("lineage_id", _quarter().alias("quarter"), (F.col("new_works") % 2).cast("int").alias("is_onset"))
    return E.backfill_outcomes(_history(spark, sf_dir), l)


@query(HISTORY + """SELECT lineage_id, quarter_predicted, probability FROM hist UNION ALL SELECT lineage_id, (q_idx // 4) || 'Q' || (q_idx % 4 + 1), 0.5::DOUBLE FROM series WHERE q_idx % 2 = 1""")
def d106_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir).select("lineage_id", "quarter_predicted", "probability")
    fresh = B.series(spark, sf_dir).select("lineage_id", _quarter().alias("quarter_predicted"), F.lit(0.5).alias("probability"))
    return E.record_predictions(h, fresh, ["lineage_id", "quarter_predicted"])


BINS = with_(SCORES) + ", b AS (SELECT least(floor(probability * 10), 9)::INTEGER AS bin, count(*) AS rows, avg(probability) AS mean_probability, avg(outcome) AS observed FROM scores GROUP BY 1)"


@query(BINS + "SELECT bin, rows, round(mean_probability, 6) AS mean_probability, round(observed, 6) AS observed FROM b")
def d107_calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_bins(B.scores(spark, sf_dir)).select("bin", "rows", *rounded(["mean_probability", "observed"]))


@query(BINS + "SELECT (SELECT count(*) FROM scores) AS rows, round((SELECT avg((probability - outcome) ** 2) FROM scores), 6) AS brier, round(sum(rows * abs(mean_probability - observed)) / sum(rows), 6) AS ece FROM b")
def d107_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_error(B.scores(spark, sf_dir)).select("rows", *rounded(["brier", "ece"]))


@query(with_(SERIES) + """, b AS (SELECT q_idx, avg(new_works % 13) AS brier FROM series GROUP BY 1), w AS (SELECT *, avg(brier) OVER r AS m, stddev_samp(brier) OVER r AS s FROM b WINDOW r AS (ORDER BY q_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT q_idx, round(brier, 6) AS brier, CASE WHEN brier > m + 1.5 * s THEN 'critical' WHEN brier > m + 0.5 * s THEN 'drift' ELSE 'none' END AS alert FROM w""")
def d108_drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.series(spark, sf_dir).groupBy("q_idx").agg(F.avg(F.col("new_works") % 13).alias("brier"))
    return E.drift_alerts(b, k=0.5, critical=1.5).withColumn("brier", F.round("brier", 6))


@query(with_(SCORES) + """, s AS (SELECT abs(probability - outcome) AS s, row_number() OVER (ORDER BY abs(probability - outcome)) AS place, count(*) OVER () AS n FROM scores)
SELECT max(n) AS n, round(max(s), 6) AS width FROM s WHERE place = least(ceil((n + 1) * 0.9::DOUBLE), n)""")
def d109_conformal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conformal_width(B.scores(spark, sf_dir)).withColumn("width", F.round("width", 6))


@query(with_(SERIES) + """, p AS (SELECT lineage_id, q_idx, (new_works % 100) / 100.0::DOUBLE AS p, row_number() OVER (PARTITION BY lineage_id ORDER BY q_idx) AS i, count(*) OVER (PARTITION BY lineage_id) AS n FROM series),
l AS (SELECT lineage_id, regr_slope(p, i) AS slope, max(q_idx) AS q, arg_max(p, i) AS p FROM p WHERE i > n - 4 GROUP BY 1),
h AS (SELECT lineage_id, (q + h)::INTEGER AS q_target, h::INTEGER AS horizon, least(1, greatest(0, p + slope * 0.7 ** h * h)) AS point FROM l, range(1, 5) r(h))
SELECT lineage_id, q_target, horizon, round(point, 6) AS point, round(greatest(0, point - 0.2), 6) AS lower, round(least(1, point + 0.2), 6) AS upper FROM h""")
def d109_horizon_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.series(spark, sf_dir).select("lineage_id", "q_idx", (F.col("new_works") % 100 / F.lit(100.0)).alias("probability"))
    return E.horizon_estimates(p, 0.2, ["lineage_id"]).select("lineage_id", "q_target", "horizon", *rounded(["point", "lower", "upper"]))


@query(with_(SCORES) + "SELECT doc_id, CASE WHEN probability >= 0.15 THEN 'watch' WHEN probability >= 0.07 THEN 'extended' ELSE 'none' END AS tier FROM scores")
def d110_alert_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.alert_tiers(B.scores(spark, sf_dir)).select("doc_id", "tier")


@query(with_(SERIES) + """, f AS (SELECT lineage_id, q_idx, (new_works % 10) / 10.0::DOUBLE AS a, ln(1 + avg(new_works) OVER (PARTITION BY lineage_id ORDER BY q_idx ROWS 3 PRECEDING)) AS b, (new_works % 9)::DOUBLE AS c, ln(1 + sum(new_works) OVER (PARTITION BY lineage_id ORDER BY q_idx)) AS d, exp(-(q_idx % 8) / 4.0::DOUBLE) AS e FROM series),
z AS (SELECT lineage_id, q_idx, 0.5 * (a - avg(a) OVER ()) / stddev_pop(a) OVER () + 0.2 * (b - avg(b) OVER ()) / stddev_pop(b) OVER () + 0.15 * (c - avg(c) OVER ()) / stddev_pop(c) OVER () + 0.1 * (d - avg(d) OVER ()) / stddev_pop(d) OVER () + 0.05 * (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS composite FROM f),
k AS (SELECT quantile_cont(composite, 0.9) AS c90, quantile_cont(composite, 0.6) AS c60 FROM z)
SELECT lineage_id, q_idx, round(composite, 5) AS composite, CASE WHEN composite >= c90 THEN 'high' WHEN composite >= c60 THEN 'medium' ELSE 'low' END AS tier FROM z, k""")
def d111_magnitude_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.numeric import so_far, trailing

    s = B.series(spark, sf_dir)
    f = s.select("lineage_id", "q_idx", (F.col("new_works") % 10 / F.lit(10.0)).alias("probability"), F.avg("new_works").over(trailing(["lineage_id"], "q_idx", 4)).alias("roll_mean_4"), (F.col("new_works") % 9).alias("acceleration"), F.sum("new_works").over(so_far(["lineage_id"], "q_idx")).alias("cumulative"), (F.col("q_idx") % 8).alias("since"))
    return E.magnitude_composite(f, ["lineage_id", "q_idx"]).withColumn("composite", F.round("composite", 5))


@query(with_(SCORES) + "SELECT round(avg(outcome), 6) AS precision_at_k FROM (SELECT outcome FROM scores ORDER BY probability DESC, doc_id LIMIT 50)")
def d111_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.precision_at(B.scores(spark, sf_dir), 50).select(F.round("precision_at_k", 6).alias("precision_at_k"))


@query(with_(SCORES) + """, q AS (SELECT doc_id, 'false_positive' AS kind, probability AS worth FROM scores WHERE probability >= 0.5 AND outcome = 0 UNION ALL SELECT doc_id, 'false_negative', probability FROM scores WHERE probability < 0.5 AND outcome = 1)
SELECT doc_id, kind, round(worth, 6) AS worth, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY worth DESC, doc_id)::INTEGER AS place FROM q) WHERE place <= 10""")
def d113_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.review_queue(B.scores(spark, sf_dir)).withColumn("worth", F.round("worth", 6))


@query(with_(SERIES) + "SELECT lineage_id, q_idx, CASE WHEN q_idx <= 7995 THEN 'train' WHEN q_idx <= 8001 THEN 'dev' ELSE 'test' END AS split FROM series")
def d115_time_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.time_forward(B.series(spark, sf_dir), 7995, 8001).select("lineage_id", "q_idx", "split")


@query(with_(SERIES) + """, d AS (SELECT (new_works % 17 - q_idx % 11)::BIGINT AS d FROM series), c AS (SELECT abs(d) AS m, count(*) AS c, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY 1),
r AS (SELECT *, COALESCE(sum(c) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0::DOUBLE AS rank FROM c), s AS (SELECT sum(c)::BIGINT AS n, sum(rank * up) AS w_plus, sum(rank * (c - up)) AS w_minus FROM r)
SELECT n, w_plus, w_minus, round((w_plus - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s""")
def d118_paired_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.series(spark, sf_dir).select((F.col("new_works") % 17).alias("a"), (F.col("q_idx") % 11).alias("b"))
    return E.paired_signed_rank(p, "a", "b").withColumn("z", F.round("z", 6))


MATCHED = with_(SERIES) + """, fa AS (SELECT DISTINCT 'F' || (lineage_id % 6) AS front, q_idx FROM series WHERE (lineage_id * 7 + q_idx * 3) % 19 = 0),
ev AS (SELECT i AS event_id, 'F' || (i % 6) || '|F' || ((i + 2) % 6) AS fronts, (7982 + i * 2)::INTEGER AS window_start, (7984 + i * 2)::INTEGER AS window_end FROM range(14) t(i)),
ex AS (SELECT event_id, trim(unnest(string_split(fronts, '|'))) AS front, window_start, window_end FROM ev), mt AS (SELECT event_id, front, q_idx, window_end - q_idx AS lead FROM fa JOIN ex USING (front) WHERE q_idx BETWEEN window_start AND window_end)"""


def _front_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select(F.concat(F.lit("F"), (F.col("lineage_id") % 6).cast("string")).alias("front"), "q_idx").distinct()


def _events(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    name = lambda c: F.concat(F.lit("F"), (c % 6).cast("string"))
    return spark.range(14).select(i.alias("event_id"), F.concat_ws("|", name(i), name(i + 2)).alias("fronts"), (7982 + i * 2).cast("int").alias("window_start"), (7984 + i * 2).cast("int").alias("window_end"))


@query(MATCHED + "SELECT * FROM mt")
def d121_event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_events(_front_alerts(spark, sf_dir), _events(spark))


@query(MATCHED + "SELECT event_id, fronts FROM ev WHERE event_id NOT IN (SELECT event_id FROM mt)")
def d121_missed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark)
    return E.missed_events(e, E.match_events(_front_alerts(spark, sf_dir), e)).select("event_id", "fronts")


@query(MATCHED + "SELECT front, q_idx FROM fa EXCEPT SELECT front, q_idx FROM mt")
def d121_false_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _front_alerts(spark, sf_dir)
    return E.false_alerts(a, E.match_events(a, _events(spark)))


@query(with_(SCORES) + """SELECT source, count(DISTINCT doc_id) AS entities, count(*) AS observations, sum(outcome)::BIGINT AS onsets, round(count(DISTINCT doc_id) FILTER (outcome = 1) / count(DISTINCT doc_id)::DOUBLE, 6) AS coverage,
  count(DISTINCT doc_id) >= 50 AND sum(outcome) >= 10 AND count(*) >= 100 AS feasible FROM scores GROUP BY 1""")
def d127_unit_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unit_feasibility(B.scores(spark, sf_dir), "source", "doc_id", "outcome", observations=100).withColumn("coverage", F.round("coverage", 6))


@query(with_(SCORES) + """, s AS (SELECT outcome, round_even(100 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 0)::INTEGER AS take FROM scores GROUP BY 1),
p AS (SELECT scores.*, take, row_number() OVER (PARTITION BY outcome ORDER BY ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT, doc_id) AS place FROM scores JOIN s USING (outcome))
SELECT doc_id, source, probability, outcome FROM p WHERE place <= take""")
def d132_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified_sample(B.scores(spark, sf_dir), "outcome", 100, "doc_id")


@query(with_(SCORES) + """SELECT source, count(*) AS n, round(avg(probability), 6) AS mean, round(median(probability), 6) AS median, round(max(probability), 6) AS max, round(stddev_samp(probability), 6) AS std, count(*) FILTER (probability >= 0.5) AS positives FROM scores GROUP BY 1""")
def d100_prediction_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.prediction_rollup(B.scores(spark, sf_dir), ["source"]).select("source", "n", "positives", *rounded(["mean", "median", "max", "std"]))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.series import growth_features

    g = growth_features(B.series(spark, sf_dir), ["lineage_id"])
    return g.withColumn("label", (F.col("new_works") > F.col("roll_mean_4") * 1.1).cast("int"))


_COLUMNS = ["delta", "yoy_delta", "acceleration", "roll_std_4", "cumulative"]


@query()
def d097_classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    model = learning.fit_classifier(f.where("q_idx <= 7999"), _COLUMNS, "label", kind="logistic")
    return learning.predict(model, f.where("q_idx > 7999")).select("lineage_id", "q_idx", F.round("probability", 6).alias("probability"), "label")


@query(with_(SCORES) + """, g AS (SELECT probability AS p, sum(outcome)::DOUBLE AS s, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY probability) AS i FROM scores GROUP BY 1),
c AS (SELECT i, p, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn, s, n FROM g), m AS (SELECT a.i AS i, b.i AS j, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.i <= b.i),
lo AS (SELECT i, j, min(mean) OVER (PARTITION BY i ORDER BY j DESC) AS least FROM m), fit AS (SELECT j AS i, max(least) AS calibrated FROM lo GROUP BY 1)
SELECT doc_id, round(calibrated, 6) AS calibrated FROM scores JOIN g ON probability = p JOIN fit USING (i)""")
def d108_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.isotonic(B.scores(spark, sf_dir)).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


@query()
def d114_feature_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.feature_signals(_features(spark, sf_dir), _COLUMNS, "label")
