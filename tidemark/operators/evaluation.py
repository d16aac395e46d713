"""Evaluation, calibration and reporting of detectors and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio, trailing
from tidemark.operators.relations import average_ranks, hash_unit

#: Weights of true positives, false positives and false negatives by profile.
PROFILES = {"standard": (1.0, 0.11, 1.0), "low_fp": (1.0, 0.22, 1.0), "low_fn": (1.0, 0.11, 2.0)}


def timeliness(y: Column) -> Column:
    """2 / (1 + exp(5 y)) - 1: 1 far before, 0 at, -1 far after."""
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(5.0) * y)) - 1


def timeliness_scores(alerts: DataFrame, truth: DataFrame, key: str = "lineage_id", window: int = 8, profiles: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Per profile: score of the first alert in [onset, onset + window], false alerts outside, misses; scaled from 0 (silent) to 100 (perfect).

    alerts (key, q_idx), truth (key, onset_q). Keys without onset count only false alerts.
    """
    joined = alerts.select(key, "q_idx").distinct().join(truth.select(key, "onset_q"), key, "left")
    inside = F.col("q_idx").between(F.col("onset_q"), F.col("onset_q") + window)
    per_key = joined.groupBy(key).agg(F.min(F.when(inside, F.col("q_idx") - F.col("onset_q"))).alias("delay"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("false_alerts"))
    everyone = truth.select(key, "onset_q").join(per_key, key, "outer")
    hit = F.when(F.col("onset_q").isNotNull() & F.col("delay").isNotNull(), timeliness(F.col("delay") / F.lit(float(window)) - 1))
    sums = everyone.agg(
        F.coalesce(F.sum(hit), F.lit(0.0)).alias("hits"), F.coalesce(F.sum("false_alerts"), F.lit(0)).alias("false_alerts"), F.count_if(F.col("onset_q").isNotNull() & F.col("delay").isNull()).alias("missed"),
        F.count("onset_q").alias("onsets"), F.avg(F.when(F.col("onset_q").isNotNull(), F.col("delay"))).alias("mean_delay"),
    )
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(a).alias("tp"), F.lit(b).alias("fp"), F.lit(c).alias("fn")) for n, (a, b, c) in (profiles or PROFILES).items()]))
    p = sums.withColumn("p", grid).select("*", "p.*")
    best = timeliness(F.lit(-1.0))
    raw = F.col("tp") * F.col("hits") - F.col("fp") * F.col("false_alerts") - F.col("fn") * F.col("missed")
    perfect, null = F.col("tp") * best * F.col("onsets"), -F.col("fn") * F.col("onsets")
    return p.select("profile", "onsets", "missed", "false_alerts", "mean_delay", raw.alias("raw"), (100 * ratio(raw - null, perfect - null)).alias("normalised"))


def detection_lags(alerts: DataFrame, truth: DataFrame, key: str = "lineage_id") -> DataFrame:
    """One row: onsets, coverage, median and mean of first alert minus onset, shares at most 0 and 2."""
    first = alerts.groupBy(key).agg(F.min("q_idx").alias("first_q"))
    lag = truth.join(first, key, "left").withColumn("lag", F.col("first_q") - F.col("onset_q"))
    return lag.agg(F.count(F.lit(1)).alias("onsets"), (F.count("lag") / F.count(F.lit(1))).alias("coverage"), F.median("lag").alias("median_lag"), F.avg("lag").alias("mean_lag"), F.avg((F.col("lag") <= 0).cast("double")).alias("by_0"), F.avg((F.col("lag") <= 2).cast("double")).alias("by_2"))


def _confusion(p: Column, t: Column, y: str) -> list[Column]:
    pred, pos = p >= t, F.col(y) == 1
    return [F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"), F.count_if(~pred & pos).alias("fn"), F.count_if(~pred & ~pos).alias("tn")]


def threshold_sweep(scores: DataFrame, thresholds: list[float], p: str = "probability", y: str = "outcome") -> DataFrame:
    """Confusion counts, precision, recall, F1, F2 and MCC for each threshold, in one aggregate."""
    rows = scores.select(p, y, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    c = rows.groupBy("threshold").agg(*_confusion(F.col(p), F.col("threshold"), y))
    return with_rates(c)


def with_rates(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "f2": ratio(5 * tp, 5 * tp + fp + 4 * fn), "mcc": ratio(tp * tn - fp * fn, root),
    })


def best_threshold(sweep: DataFrame, floor: float | None = None) -> DataFrame:
    """The threshold of best F1; with a floor the one of highest recall at that precision, or of highest recall. First of ties."""
    if floor is None:
        return sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")
    order = F.struct((F.col("precision") >= floor).alias("enough"), "recall", -F.col("threshold"))
    return sweep.agg(F.max_by(F.struct(*sweep.columns), order).alias("b")).select("b.*")


def ranking_quality(scores: DataFrame, p: str = "probability", y: str = "outcome") -> DataFrame:
    """One row: average precision and ROC AUC, ties of the score counted together. Counts by score first: one row for each distinct score."""
    by = scores.groupBy(p).agg(F.sum(y).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    c = by.withColumns({"tp": F.sum("pos").over(w), "seen": F.sum("n").over(w)})
    every = Window.partitionBy()
    c = c.withColumns({"positives": F.sum("pos").over(every), "rows": F.sum("n").over(every)})
    neg = F.col("n") - F.col("pos")
    ap = F.sum(ratio(F.col("pos"), F.col("positives")) * F.col("tp") / F.col("seen"))
    auc = F.sum(neg * (F.col("tp") - F.col("pos") / 2)) / F.max(F.col("positives") * (F.col("rows") - F.col("positives")))
    return c.agg(F.max("rows").cast("long").alias("rows"), F.max("positives").cast("long").alias("positives"), ap.alias("average_precision"), auc.alias("roc_auc"))


def calibration_bins(scores: DataFrame, p: str = "probability", y: str = "outcome", bins: int = 10) -> DataFrame:
    """Rows, mean probability and observed rate by equal-width bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_probability"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration_error(scores: DataFrame, p: str = "probability", y: str = "outcome", bins: int = 10) -> DataFrame:
    """One row: Brier score and expected calibration error."""
    b = calibration_bins(scores, p, y, bins)
    ece = b.agg((F.sum(F.col("rows") * F.abs(F.col("mean_probability") - F.col("observed"))) / F.sum("rows")).alias("ece"))
    brier = scores.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))
    return brier.crossJoin(F.broadcast(ece))  # one row each


def drift_alerts(brier: DataFrame, order: str = "q_idx", value: str = "brier", window: int = 5, k: float = 2.0, critical: float = 3.0) -> DataFrame:
    """drift where a value exceeds mean + k deviations of the `window` before; critical at `critical` deviations."""
    w = Window.orderBy(order).rowsBetween(-window, -1)  # one row for each quarter
    mean, std = F.avg(value).over(w), F.stddev_samp(value).over(w)
    over = F.when(F.col(value) > mean + critical * std, "critical").when(F.col(value) > mean + k * std, "drift").otherwise("none")
    return brier.select(order, value, F.coalesce(over, F.lit("none")).alias("alert"))


def record_predictions(history: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    """History with new predictions appended; of one key the row in history stays."""
    fresh = predictions.join(history.select(*key), key, "left_anti")
    return history.unionByName(fresh, allowMissingColumns=True)


def backfill_outcomes(history: DataFrame, labels: DataFrame, key: str = "lineage_id") -> DataFrame:
    """Unknown outcomes (-1) filled from labels of the same quarter (explicit), or as 0 where the lineage has labels of other quarters only after it (implicit)."""
    known = labels.select(key, F.col("quarter").alias("quarter_predicted"), F.col("is_onset").alias("label_"))
    seen = labels.select(key).distinct().withColumn("seen_", F.lit(True))
    joined = history.join(known, [key, "quarter_predicted"], "left").join(seen, key, "left")
    unknown = F.col("actual_outcome") == -1
    out = F.when(unknown & F.col("label_").isNotNull(), F.col("label_")).when(unknown & F.col("seen_").isNotNull(), 0).otherwise(F.col("actual_outcome"))
    source = F.when(unknown & F.col("label_").isNotNull(), "explicit").when(unknown & F.col("seen_").isNotNull(), "implicit").otherwise(F.col("outcome_source"))
    return joined.withColumns({"actual_outcome": out, "outcome_source": source}).drop("label_", "seen_")


def conformal_width(scores: DataFrame, alpha: float = 0.1, p: str = "probability", y: str = "outcome") -> DataFrame:
    """One row: the ceil((n + 1)(1 - alpha)) / n quantile of |p - y|; 0.5 with fewer than two rows."""
    s = scores.select(F.abs(F.col(p) - F.col(y)).alias("s")).where("s IS NOT NULL").groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    # One row for each distinct residual: what is sorted is their counts.
    upto = F.sum("c").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    counted = s.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy())})
    at = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    got = counted.where(F.col("upto") >= at).agg(F.max("n").alias("n"), F.min("s").alias("s"))
    return got.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= 2, F.col("s")).otherwise(F.lit(0.5)).alias("width"))


def horizon_estimates(predictions: DataFrame, width: float, keys: list[str], horizons: int = 4, damping: float = 0.7, p: str = "probability") -> DataFrame:
    """For the last quarter of each key: point and bounds for the next horizons, from the slope of the last four values, damped by horizon."""
    w = Window.partitionBy(*keys).orderBy("q_idx")
    n = F.count(F.lit(1)).over(trailing(keys, "q_idx", 4))
    rows = predictions.withColumn("i", F.row_number().over(w))
    y4 = trailing(keys, "q_idx", 4)
    sx, sy, sxx, sxy = F.sum("i").over(y4), F.sum(p).over(y4), F.sum(F.col("i") * F.col("i")).over(y4), F.sum(F.col("i") * F.col(p)).over(y4)
    slope = F.coalesce(F.try_divide(n * sxy - sx * sy, (n * sxx - sx * sx).cast("double")), F.lit(0.0))
    last = rows.withColumns({"slope": slope, "last_": F.max("i").over(Window.partitionBy(*keys))}).where("i = last_")
    h = last.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    point = clip(F.col(p) + F.col("slope") * F.pow(F.lit(damping), F.col("horizon")) * F.col("horizon"))
    return h.select(*keys, (F.col("q_idx") + F.col("horizon")).alias("q_target"), "horizon", point.alias("point"), clip(point - width).alias("lower"), clip(point + width).alias("upper"))


def alert_tiers(predictions: DataFrame, p: str = "probability", watch: float = 0.15, extended: float = 0.07) -> DataFrame:
    tier = F.when(F.col(p) >= watch, "watch").when(F.col(p) >= extended, "extended").otherwise("none")
    return predictions.withColumn("tier", tier)


def magnitude_composite(features: DataFrame, keys: list[str], weights: tuple[float, ...] = (0.5, 0.2, 0.15, 0.1, 0.05)) -> DataFrame:
    """Weighted z-scores (population) of probability, log recent mean, acceleration, log total and recency, with tiers by the 90th and 60th percentile."""
    parts = {"z0": F.col("probability"), "z1": F.log1p("roll_mean_4"), "z2": F.col("acceleration").cast("double"), "z3": F.log1p("cumulative"), "z4": F.exp(-F.col("since") / 4.0)}
    base = features.select(*keys, *[c.alias(n) for n, c in parts.items()])
    stats = base.agg(*[F.avg(n).alias(f"m_{n}") for n in parts], *[F.stddev_pop(n).alias(f"s_{n}") for n in parts])
    z = base.crossJoin(F.broadcast(stats))  # one row
    score = sum((F.lit(w) * ratio(F.col(n) - F.col(f"m_{n}"), F.col(f"s_{n}")) for n, w in zip(parts, weights, strict=True)), F.lit(0.0))
    scored = z.select(*keys, score.alias("composite"))
    cuts = scored.agg(F.percentile("composite", F.lit(0.9)).alias("c90"), F.percentile("composite", F.lit(0.6)).alias("c60"))
    tier = F.when(F.col("composite") >= F.col("c90"), "high").when(F.col("composite") >= F.col("c60"), "medium").otherwise("low")
    return scored.crossJoin(F.broadcast(cuts)).select(*keys, "composite", tier.alias("tier"))  # one row


def precision_at(scores: DataFrame, k: int, p: str = "probability", y: str = "outcome", key: str = "doc_id") -> DataFrame:
    """Share of positives among the k best scores, ties by key."""
    return scores.orderBy(F.desc(p), key).limit(k).agg(F.avg(F.col(y).cast("double")).alias("precision_at_k"))


def match_events(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts (front, q_idx) against events (event_id, fronts joined by |, window_start, window_end): event, alert and lead quarters.

    Fronts become rows, so that the join is on equality with the window as its residual.
    """
    e = events.withColumn("front", F.explode(F.split("fronts", "\\|"))).select("event_id", F.trim("front").alias("front"), "window_start", "window_end")
    hits = alerts.join(e, "front").where("q_idx BETWEEN window_start AND window_end")
    return hits.select("event_id", "front", "q_idx", (F.col("window_end") - F.col("q_idx")).alias("lead"))


def missed_events(events: DataFrame, matches: DataFrame) -> DataFrame:
    return events.join(matches.select("event_id").distinct(), "event_id", "left_anti")


def false_alerts(alerts: DataFrame, matches: DataFrame) -> DataFrame:
    return alerts.join(matches.select("front", "q_idx").distinct(), ["front", "q_idx"], "left_anti")


def unit_feasibility(rows: DataFrame, unit: str, entity: str, onset: str, entities: int = 50, onsets: int = 10, observations: int = 500) -> DataFrame:
    """By detection unit: entities, observations, onsets, coverage and whether a model can be trained."""
    s = rows.groupBy(unit).agg(F.countDistinct(entity).alias("entities"), F.count(F.lit(1)).alias("observations"), F.sum(onset).cast("long").alias("onsets"), F.countDistinct(F.when(F.col(onset) == 1, F.col(entity))).alias("with_onset"))
    return s.select(unit, "entities", "observations", "onsets", ratio(F.col("with_onset"), F.col("entities")).alias("coverage"), ((F.col("entities") >= entities) & (F.col("onsets") >= onsets) & (F.col("observations") >= observations)).alias("feasible"))


def review_queue(scores: DataFrame, k: int = 10, threshold: float = 0.5, p: str = "probability", y: str = "outcome", key: str = "doc_id", magnitude: str = "probability") -> DataFrame:
    """The k strongest false positives and the k largest false negatives, ranked."""
    fp = scores.where((F.col(p) >= threshold) & (F.col(y) == 0)).withColumns({"kind": F.lit("false_positive"), "worth": F.col(p)})
    fn = scores.where((F.col(p) < threshold) & (F.col(y) == 1)).withColumns({"kind": F.lit("false_negative"), "worth": F.col(magnitude)})
    both = fp.select(key, "kind", "worth").union(fn.select(key, "kind", "worth"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("worth"), key))
    return both.withColumn("place", place).where(F.col("place") <= k)


def stratified_sample(rows: DataFrame, label: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """About n rows that keep the label's shares (rounded for each label), chosen by hash order: the same in every run."""
    total = Window.partitionBy()
    share = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c")).withColumn("take", F.bround(n * F.col("c") / F.sum("c").over(total)).cast("int"))
    place = F.row_number().over(Window.partitionBy(label).orderBy(hash_unit(F.col(key), seed=seed), key))
    return rows.withColumn("place_", place).join(F.broadcast(share.select(label, "take")), label).where("place_ <= take").select(*rows.columns)  # one row for each label


def paired_signed_rank(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Wilcoxon's signed-rank sums of a - b (zeros left out, average ranks of ties) with the normal approximation's z."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ranked = average_ranks(d, ["m"])
    up = F.col("d") > 0
    s = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(up, F.col("m_rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(~up, F.col("m_rank"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")
    return s.withColumn("z", ratio(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))


def time_forward(rows: DataFrame, train_to: int, dev_to: int) -> DataFrame:
    """Adds split: train up to a quarter, dev up to a later one, then test."""
    return rows.withColumn("split", F.when(F.col("q_idx") <= train_to, "train").when(F.col("q_idx") <= dev_to, "dev").otherwise("test"))


def prediction_rollup(scores: DataFrame, keys: list[str], p: str = "probability", threshold: float = 0.5) -> DataFrame:
    """Number, mean, median, greatest and deviation (samples) of probabilities, and positives, by keys."""
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.max(p).alias("max"), F.stddev_samp(p).alias("std"), F.count_if(F.col(p) >= threshold).alias("positives"))


def lag_summary(nearest: DataFrame, by: str) -> DataFrame:
    """By `by`: rows, the share with a milestone, median and mean lag and the share of each lag bucket, from series.nearest_event."""
    n = F.count(F.lit(1))
    shares = [(F.count_if(F.col("bucket") == b) / n).alias(name) for b, name in (("<4q", "under_4"), ("4-8q", "from_4"), ("8-12q", "from_8"), (">=12q", "from_12"))]
    return nearest.groupBy(by).agg(n.alias("rows"), (F.count("lag") / n).alias("coverage"), F.median("lag").alias("median_lag"), F.avg("lag").alias("mean_lag"), *shares)


def briefing_rows(predictions: DataFrame, key: str, p: str = "probability", k: int = 10) -> DataFrame:
    """The k highest tiers of the latest quarter: tier, key, probability, change since the quarter before and place."""
    w = Window.partitionBy(key).orderBy("q_idx")
    changed = predictions.withColumn("change", F.col(p) - F.lag(p).over(w))
    last = predictions.agg(F.max("q_idx").alias("last_q"))
    latest = alert_tiers(changed, p).join(F.broadcast(last), F.col("q_idx") == F.col("last_q")).where("tier <> 'none'")  # one row
    best = latest.orderBy(F.desc(p), key).limit(k)
    return best.select("q_idx", "tier", key, F.col(p).alias("probability"), "change", F.row_number().over(Window.orderBy(F.desc(p), key)).alias("place"))  # k rows


def briefing(rows: DataFrame, key: str, title: str = "Quarterly briefing") -> str:
    """Markdown of briefing_rows, written on the driver."""
    found = rows.orderBy("place").collect()
    lines = [f"# {title}", ""]
    for tier in ("watch", "extended"):
        own = [r for r in found if r["tier"] == tier]
        lines += [f"## {tier.capitalize()} ({len(own)})", ""]
        lines += [f"{r['place']}. {r[key]}: {r['probability']:.3f}" + (f" ({r['change']:+.3f})" if r["change"] is not None else "") for r in own]
        lines.append("")
    return "\n".join(lines)
