"""Detectors on quarterly series: bursts, onset, maturation, changepoints, heuristics and their combinations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import all_of, ordered, ratio, so_far, trailing
from tidemark.operators import kernels as K
from tidemark.operators.relations import hash_unit
from tidemark.operators.series import densify


def burst_background(series: DataFrame, keys: list[str], value: str = "count", lookback: int = 12, need: int = 8, min_count: int = 0) -> DataFrame:
    """Dense grid with mean and sample variance of the `lookback` quarters before, the model (Poisson, NB, Zero) and dispersion k.

    Of these quarters only those of min_count or more make the history, and `need` of them must be left.
    """
    dense = densify(series, keys, value, whole_range=True)
    w = trailing(keys, "q_idx", lookback, -1)
    held = F.when(F.col(value) >= min_count, F.col(value))
    out = dense.withColumns({"history": F.count(held).over(w), "mu": F.avg(held).over(w), "variance": F.var_samp(held).over(w)}).where(F.col("history") >= need)
    model = F.when(F.col("mu") < 1e-9, "Zero").when(F.col("variance") <= F.col("mu"), "Poisson").otherwise("NB")
    return out.withColumns({"model": model, "k": F.when(model == "NB", F.col("mu") ** 2 / (F.col("variance") - F.col("mu")))})


def burst_alerts(series: DataFrame, keys: list[str], value: str = "count", lookback: int = 12, need: int = 8, alpha: float = 0.1, min_count: int = 0) -> DataFrame:
    """Upper-tail p-value against the background, Benjamini-Hochberg q-value over the groups of a quarter, alert if q <= alpha.

    Rows of model Zero count among the tests of their quarter, then go. The tail is the one step outside SQL: a map over
    batches, without a shuffle.
    """
    rows = burst_background(series, keys, value, lookback, need, min_count)

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, mu, k, model = (b[c].to_numpy() for c in (value, "mu", "k", "model"))
            p = np.where(x > 0, 0.0, 1.0)
            some = model == "Poisson"
            p[some] = K.poisson_tail(x[some], mu[some])
            some = model == "NB"
            p[some] = K.negative_binomial_tail(x[some], mu[some], k[some].astype(float))
            yield b.assign(p_value=p)

    tested = rows.mapInPandas(tails, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", p_value double")
    order = Window.partitionBy("q_idx").orderBy("p_value", *keys)
    tested = tested.withColumns({"rank": F.row_number().over(order), "tests": F.count(F.lit(1)).over(Window.partitionBy("q_idx"))})
    q = F.min(F.col("p_value") * F.col("tests") / F.col("rank")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return tested.withColumn("q_value", q).where("model <> 'Zero'").select(*keys, "q_idx", value, "mu", "variance", "model", "k", "p_value", "q_value", ratio(F.col(value), F.col("mu")).alias("rate_ratio"), (F.col("q_value") <= alpha).alias("alert"))


def onsets(series: DataFrame, keys: list[str], value: str = "new_works", window: int = 3, floor: float = 3.0, growth: float = 0.1, confirm: int = 3) -> DataFrame:
    """The first quarter whose smoothed value is at least floor, grows by `growth` and keeps growing for `confirm` quarters.

    Smoothing is a trailing mean; growth is relative to max(previous, 1). Groups shorter than window + confirm give
    insufficient_history; one row for each group, onset_q null if there is none.
    """
    if window < 1 or confirm < 1 or floor < 0:
        raise ValueError("window and confirm must be positive, floor not negative")
    w = ordered(keys, "q_idx")
    smooth = series.withColumns({"s": F.avg(value).over(trailing(keys, "q_idx", window)), "place": F.row_number().over(w) - 1})
    prev = F.lag("s").over(w)
    grown = smooth.withColumn("g", (F.col("s") - prev) / F.greatest(prev, F.lit(1.0)))
    ahead = w.rowsBetween(0, confirm - 1)
    marked = grown.withColumns({"least_": F.min("g").over(ahead), "n_": F.count("g").over(ahead)})
    hit = all_of([F.col("place") >= 1, F.col("s") >= floor, F.col("g") >= growth, F.col("least_") > 0, F.col("n_") == confirm])
    out = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(hit, F.struct("q_idx", "place", "s", "g"))).alias("o"))
    enough = F.col("n") >= window + confirm
    found = enough & F.col("o").isNotNull()
    reason = F.when(~enough, "insufficient_history").when(found, "detected").otherwise("no_onset")
    pick = lambda f: F.when(found, F.col(f"o.{f}"))
    return out.select(*keys, reason.alias("reason"), pick("q_idx").alias("onset_q"), pick("s").alias("smoothed"), pick("g").alias("growth"), F.when(found, F.col("o.place") <= 1).alias("early"))


def maturations(series: DataFrame, keys: list[str], value: str = "new_works", window: int = 3, floor: float = 2.0, theta: float = 0.1, least: float = 5.0, confirm: int = 4) -> DataFrame:
    """From the first peak of the smoothed series on, the first quarter at which dormancy (below floor), senescence (growth below
    -theta) or saturation (|growth| below theta at `least` or more) begins to hold for `confirm` quarters, checked in this order."""
    w = ordered(keys, "q_idx")
    smooth = series.withColumns({"s": F.avg(value).over(trailing(keys, "q_idx", window)), "place": F.row_number().over(w) - 1})
    prev = F.lag("s").over(w)
    g = smooth.withColumns({"g": (F.col("s") - prev) / F.greatest(prev, F.lit(1.0)), "peak": F.min_by("place", F.struct(-F.col("s"), "place")).over(Window.partitionBy(*keys))})
    ahead = w.rowsBetween(0, confirm - 1)
    held = lambda c: (F.min(F.coalesce(c, F.lit(False)).cast("int")).over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == confirm)
    kind = F.when(held(F.col("s") < floor), "dormancy").when(held(F.col("g") < -theta), "senescence").when(held((F.abs("g") < theta) & (F.col("s") >= least)), "saturation")
    marked = g.withColumn("kind", kind).where(F.col("place") >= F.col("peak"))
    first = marked.groupBy(*keys).agg(F.min(F.when(F.col("kind").isNotNull(), F.struct("q_idx", "kind", "place"))).alias("m"), F.max("place").alias("last_"))
    return first.select(*keys, F.col("m.q_idx").alias("maturation_q"), F.col("m.kind").alias("kind"), (F.col("m.place") + confirm > F.col("last_")).alias("late"))


def changepoint_probabilities(series: DataFrame, keys: list[str], value: str = "new_works", hazard: float = 1 / 50, longest: int = 40, window: int = 3, threshold: float = 0.5) -> DataFrame:
    """Run-length filter of each group in time order: P(run <= window), alert and likeliest run length. A group is one series of quarters."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("q_idx")
        p, length = K.run_length_filter(group[value].to_numpy(dtype=float), hazard, longest, window)
        return group[[*keys, "q_idx"]].assign(changepoint_prob=p, alert=p > threshold, run_length=length)

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    return series.select(*keys, "q_idx", value).groupBy(*keys).applyInPandas(run, f"{kinds}, q_idx int, changepoint_prob double, alert boolean, run_length int")


def burst_periods(series: DataFrame, keys: list[str], value: str = "new_works", ratio_: float = 2.0, gamma: float = 1.0, states: int = 3, least: int = 3, most: int = 8) -> DataFrame:
    """State of each quarter and whether it lies in a run of raised states of least to most quarters."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("q_idx")
        state = K.burst_states(group[value].to_numpy(dtype=float), ratio_, gamma, states)
        raised = state > 0
        run_id = np.cumsum(np.diff(raised.astype(int), prepend=0) != 0)
        length = pd.Series(raised).groupby(run_id).transform("size").to_numpy()
        return group[[*keys, "q_idx"]].assign(state=state, burst=raised & (length >= least) & (length <= most))

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    return series.select(*keys, "q_idx", value).groupBy(*keys).applyInPandas(run, f"{kinds}, q_idx int, state int, burst boolean")


def vector_changepoints(vectors: DataFrame, keys: list[str], vector: str = "v", penalty: float = 1.0) -> DataFrame:
    """Quarters at which the segments of a group's vectors in time order begin."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("q_idx")
        cuts = K.kernel_changepoints(np.stack(group[vector].to_list()).astype(float), penalty)
        return group.iloc[cuts][[*keys, "q_idx"]]

    kinds = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)
    return vectors.select(*keys, "q_idx", vector).groupBy(*keys).applyInPandas(run, f"{kinds}, q_idx int")


def causal_logistic(series: DataFrame, keys: list[str], value: str = "new_works", least: int = 8, need_r2: float = 0.7) -> DataFrame:
    """For every prefix of `least` quarters or more of the running total: growth rate, midpoint and fit of a logistic curve, null below need_r2."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("q_idx")
        y = group[value].to_numpy(dtype=float).cumsum()
        rows = []
        for n in range(least, len(y) + 1):
            _, rate, middle, r2 = K.logistic_fit(y[:n])
            rows.append((int(group["q_idx"].iloc[n - 1]), rate if r2 >= need_r2 else None, middle if r2 >= need_r2 else None, r2))
        out = pd.DataFrame(rows, columns=["q_idx", "rate", "midpoint", "r2"])
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "q_idx", "rate", "midpoint", "r2"]]

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    return series.select(*keys, "q_idx", value).groupBy(*keys).applyInPandas(run, f"{kinds}, q_idx int, rate double, midpoint double, r2 double")


def retrospective_inflections(series: DataFrame, keys: list[str], value: str = "new_works", least_total: int = 20, least_recent: int = 8) -> DataFrame:
    """Inflection of a whole series: midpoint of a good logistic fit of the total, else the first strong rise of the smoothed series.

    Needs a total and a last year of some size. A rise is a first difference (centred mean of 3) of mean + 1.5 deviations or
    more with a positive second difference. method: logistic, derivative or none.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("q_idx")
        x = group[value].to_numpy(dtype=float)
        at, method, n = None, "none", len(x)
        if x.sum() >= least_total and x[-4:].sum() >= least_recent:
            _, _, middle, r2 = K.logistic_fit(x.cumsum()) if n >= 12 else (0, 0, -1, 0)
            place = int(np.round(middle))
            if r2 >= 0.85 and 1 < place < n - 2:
                at, method = place, "logistic"
            elif n >= 5:
                smooth = pd.Series(x).rolling(3, center=True, min_periods=1).mean().to_numpy()
                first = np.diff(smooth, prepend=smooth[0])
                second = np.diff(first, prepend=first[0])
                hits = np.flatnonzero((first >= first.mean() + 1.5 * first.std(ddof=1)) & (second > 0))
                hits = hits[hits < n - 2]
                if len(hits):
                    at, method = int(hits[0]), "derivative"
        out = group[keys].iloc[:1].copy()
        out["inflection_q"] = pd.array([int(group["q_idx"].iloc[at]) if at is not None else None], dtype="Int32")
        out["method"] = method
        return out

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    return series.select(*keys, "q_idx", value).groupBy(*keys).applyInPandas(run, f"{kinds}, inflection_q int, method string")


def growth_alerts(series: DataFrame, keys: list[str], value: str = "new_works", theta: float = 0.5) -> DataFrame:
    """Growth relative to max(previous, 1) and whether it reaches theta."""
    w, x = ordered(keys, "q_idx"), F.col(value)
    prev = F.lag(x).over(w)
    g = F.coalesce((x - prev) / F.greatest(prev, F.lit(1)), F.lit(0.0))
    return series.select(*keys, "q_idx", g.alias("growth"), (g >= theta).alias("alert"))


def random_alerts(series: DataFrame, keys: list[str], rate: float = 0.05, seed: int = 42) -> DataFrame:
    """Alerts of a given rate by a hash of keys and quarter: the same in every run."""
    return series.select(*keys, "q_idx", (hash_unit(*[F.col(k) for k in (*keys, "q_idx")], seed=seed) < rate).alias("alert"))


def size_heuristics(series: DataFrame, keys: list[str], value: str = "new_works", least_group: int = 100, share: float = 0.9, least_total: int = 10) -> DataFrame:
    """z of growth acceleration within terciles of the running total (over all rows where a tercile is small), and rules on its percentile.

    single: z reaches the percentile and the total is large enough; momentum: two of the last three quarters do.
    """
    w, x = ordered(keys, "q_idx"), F.col(value)
    d = series.withColumns({"cumulative": F.sum(x).over(so_far(keys, "q_idx")), "delta": F.coalesce(x - F.lag(x).over(w), F.lit(0))})
    d = d.withColumn("accel", (F.col("delta") - F.coalesce(F.lag("delta").over(w), F.lit(0))).cast("double"))
    cuts = d.agg(F.percentile("cumulative", F.lit(0.33)).alias("c33"), F.percentile("cumulative", F.lit(0.67)).alias("c67"), F.avg("accel").alias("gm"), F.stddev_pop("accel").alias("gs"))
    d = d.crossJoin(F.broadcast(cuts)).withColumn("tercile", F.when(F.col("cumulative") <= F.col("c33"), 0).when(F.col("cumulative") <= F.col("c67"), 1).otherwise(2))  # one row
    sizes = d.groupBy("tercile").agg(F.count(F.lit(1)).alias("tn"), F.avg("accel").alias("tm"), F.stddev_samp("accel").alias("ts"))
    d = d.join(F.broadcast(sizes), "tercile")  # three rows
    use = F.col("tn") >= least_group
    d = d.withColumn("z", ratio(F.col("accel") - F.when(use, F.col("tm")).otherwise(F.col("gm")), F.when(use, F.col("ts")).otherwise(F.col("gs"))))
    high = d.crossJoin(F.broadcast(d.agg(F.percentile("z", F.lit(share)).alias("cut"))))  # one row
    hit = (F.col("z") >= F.col("cut")).cast("int")
    big = F.col("cumulative") >= least_total
    return high.select(*keys, "q_idx", "z", ((hit == 1) & big).alias("single"), ((F.sum(hit).over(trailing(keys, "q_idx", 3)) >= 2) & big).alias("momentum"))


def two_signals(series: DataFrame, keys: list[str], value: str = "new_works", share: float = 0.9) -> DataFrame:
    """Acceleration and volatility (deviation of three quarters) of growth relative to previous + 1; flag where both exceed their percentile."""
    w, x = ordered(keys, "q_idx"), F.col(value)
    prev = F.lag(x).over(w)
    g = series.withColumn("growth", F.coalesce((x - prev) / (prev + 1), F.lit(0.0)))
    g = g.withColumns({"acceleration": F.coalesce(F.col("growth") - F.lag("growth").over(w), F.lit(0.0)), "volatility": F.coalesce(F.stddev_samp("growth").over(trailing(keys, "q_idx", 3)), F.lit(0.0))})
    cut = g.agg(F.percentile("acceleration", F.lit(share)).alias("ca"), F.percentile("volatility", F.lit(share)).alias("cv"))
    both = g.crossJoin(F.broadcast(cut))  # one row
    return both.select(*keys, "q_idx", "growth", "acceleration", "volatility", ((F.col("acceleration") > F.col("ca")) & (F.col("volatility") > F.col("cv"))).alias("flag"))


def hybrid_rules(signals: DataFrame, keys: list[str], p: str = "changepoint_prob", g: str = "growth", cut_p: float = 0.3, cut_g: float = 0.3, ahead: int = 2) -> DataFrame:
    """Both signals alone, in sequence (growth within `ahead` quarters of the changepoint), together, either and weighted (.6, .4)."""
    w = ordered(keys, "q_idx")
    has_p, has_g = F.col(p) >= cut_p, F.col(g) >= cut_g
    recent = F.max(has_p.cast("int")).over(w.rowsBetween(-ahead, 0)) == 1
    weighted = 0.6 * F.col(p) + 0.4 * F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0))
    return signals.select(*keys, "q_idx", has_p.alias("changepoint_only"), has_g.alias("growth_only"), (recent & has_g).alias("sequential"), (has_p & has_g).alias("conjunctive"), (has_p | has_g).alias("disjunctive"), (weighted >= 0.3).alias("weighted"))


def persistent(predictions: DataFrame, keys: list[str], p: str = "probability", threshold: float = 0.7, window: int = 2) -> DataFrame:
    """Flag where the probability and its rolling mean (of a full window) reach the threshold."""
    w = trailing(keys, "q_idx", window)
    mean = F.when(F.count(p).over(w) == window, F.avg(p).over(w))
    return predictions.withColumn("persistent", F.coalesce((F.col(p) >= threshold) & (mean >= threshold), F.lit(False)))


def label_windows(series: DataFrame, events: DataFrame, keys: list[str], after: int = 2, until: int = 8) -> DataFrame:
    """is_onset of each quarter: 1 within [event + after, event + until]. Events become one row for each quarter, so the join is on equality."""
    hits = events.select(*keys, F.explode(F.sequence(F.col("event_q") + after, F.col("event_q") + until)).alias("q_idx")).distinct().withColumn("is_onset", F.lit(1))
    return series.join(hits, [*keys, "q_idx"], "left").withColumn("is_onset", F.coalesce("is_onset", F.lit(0)))


def alerts_to_field(alerts: DataFrame, fronts: str = "front", min_fronts: int = 2, min_ratio: float = 1.5) -> DataFrame:
    """By quarter: number and sorted list of alerting fronts, greatest rate ratio, excess, least q, count, and a field alert of enough fronts or a high ratio."""
    a = alerts.where("alert").groupBy("q_idx").agg(
        F.countDistinct(fronts).alias("n_fronts"), F.array_join(F.array_sort(F.collect_set(fronts)), "|").alias("fronts"), F.max("rate_ratio").alias("max_ratio"),
        F.sum(F.col("count") - F.col("mu")).alias("excess"), F.min("q_value").alias("min_q"), F.sum("count").alias("total"),
    )
    return a.withColumn("field_alert", (F.col("n_fronts") >= min_fronts) | (F.col("max_ratio") >= min_ratio))


def burst_parameter_sweep(series: DataFrame, keys: list[str], settings: list[tuple[int, int, float]], events: DataFrame, value: str = "count", before: int = 4) -> DataFrame:
    """For each (lookback, min_count, alpha): tests, alerts, groups that alert, and how alerts meet events (keys, event_q).

    An alert is a hit if its group has an event within the next `before` quarters or now; precision is over alerts, recall over
    events that an alert precedes, lead the mean quarters from an event's first such alert. Settings of one (lookback, min_count)
    share their p-values; the driver only lists the settings.
    """
    near = events.select(*keys, "event_q", F.explode(F.sequence(F.col("event_q") - before, F.col("event_q"))).alias("q_idx"))
    total = events.agg(F.count(F.lit(1)).alias("events"))
    out = None
    for lookback, min_count in sorted({s[:2] for s in settings}):
        alphas = sorted({a for l, m, a in settings if (l, m) == (lookback, min_count)})
        tested = burst_alerts(series, keys, value, lookback, min(8, lookback), min_count=min_count)
        grid = tested.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
        alert = F.col("q_value") <= F.col("alpha")
        counts = grid.groupBy("alpha").agg(F.count(F.lit(1)).alias("tests"), F.count_if(alert).alias("alerts"), F.countDistinct(F.when(alert, F.struct(*keys))).alias("groups"))
        met = grid.where(alert).join(near, [*keys, "q_idx"])
        hits = met.groupBy("alpha").agg(F.countDistinct(*keys, "q_idx").alias("hits"))
        found = met.groupBy("alpha", *keys, "event_q").agg(F.max(F.col("event_q") - F.col("q_idx")).alias("lead")).groupBy("alpha").agg(F.count(F.lit(1)).alias("found"), F.avg("lead").alias("lead"))
        one = counts.join(hits, "alpha", "left").join(found, "alpha", "left").crossJoin(F.broadcast(total))  # one row for each alpha
        one = one.fillna(0, ["hits", "found"]).withColumns({"lookback": F.lit(lookback), "min_count": F.lit(min_count)})
        out = one if out is None else out.unionByName(one)
    precision, recall = ratio(F.col("hits"), F.col("alerts")), ratio(F.col("found"), F.col("events"))
    return out.select("lookback", "min_count", "alpha", "tests", "alerts", "groups", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), "lead")


def drawn_settings(n: int = 50, seed: int = 42) -> list[tuple[int, int, float]]:
    """n random (lookback, min_count, alpha), the same in every run."""
    draw = np.random.default_rng(seed)
    return [(int(draw.integers(8, 21)), int(draw.integers(0, 6)), round(float(draw.uniform(0.01, 0.3)), 3)) for _ in range(n)]


#: One-at-a-time grid of (hazard, window, threshold, shape, rate) around the default.
CALIBRATION_GRID = [
    (1 / 50, 3, 0.5, 1.0, 0.1), (1 / 20, 3, 0.5, 1.0, 0.1), (1 / 30, 3, 0.5, 1.0, 0.1), (1 / 100, 3, 0.5, 1.0, 0.1), (1 / 200, 3, 0.5, 1.0, 0.1),
    (1 / 50, 1, 0.5, 1.0, 0.1), (1 / 50, 2, 0.5, 1.0, 0.1), (1 / 50, 5, 0.5, 1.0, 0.1), (1 / 50, 3, 0.3, 1.0, 0.1), (1 / 50, 3, 0.7, 1.0, 0.1), (1 / 50, 3, 0.9, 1.0, 0.1),
    (1 / 50, 3, 0.5, 0.5, 0.1), (1 / 50, 3, 0.5, 2.0, 0.1), (1 / 50, 3, 0.5, 1.0, 0.05), (1 / 50, 3, 0.5, 1.0, 0.5),
]


def changepoint_calibration(series: DataFrame, keys: list[str], truth: DataFrame, settings: list[tuple[float, int, float, float, float]] = CALIBRATION_GRID, value: str = "new_works", after: int = 4, every: int = 10) -> DataFrame:
    """For each (hazard, window, threshold, shape, rate): mean, greatest probability and alert rate; the share of onsets (keys, onset_q)
    with an alert within `after` quarters and its mean lag; and the false-alarm rate of groups without onset, at every tenth quarter.

    All settings in one grouped pass over the series.
    """
    names = ["hazard", "window", "threshold", "shape", "rate"]
    grid = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s, strict=True)]) for s in settings]))
    rows = series.select(*keys, "q_idx", value, grid.alias("s")).select(*keys, "q_idx", value, "s.*")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("q_idx")
        f = group.iloc[0]
        p, _ = K.run_length_filter(group[value].to_numpy(dtype=float), float(f["hazard"]), 40, int(f["window"]), float(f["shape"]), float(f["rate"]))
        return group[[*keys, *names, "q_idx"]].assign(place=np.arange(len(group)), p=p)

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    found = rows.groupBy(*keys, *names).applyInPandas(run, f"{kinds}, hazard double, window int, threshold double, shape double, rate double, q_idx int, place int, p double")
    known = found.join(truth.select(*keys, "onset_q"), keys, "left")
    # The first quarters have probability 1 by construction, so they are no alerts.
    alert = (F.col("p") > F.col("threshold")) & (F.col("place") > F.col("window"))
    per_group = known.groupBy(*keys, *names).agg(
        F.sum("p").alias("p_sum"), F.max("p").alias("p_max"), F.count(F.lit(1)).alias("n"), F.count_if(alert).alias("alerts"), F.max("onset_q").alias("onset_q"),
        F.min(F.when(alert & F.col("q_idx").between(F.col("onset_q"), F.col("onset_q") + after), F.col("q_idx") - F.col("onset_q"))).alias("lag"),
        F.count_if(alert & (F.col("place") % every == 0)).alias("sampled_alerts"), F.count_if(F.col("place") % every == 0).alias("sampled"),
    )
    quiet = F.col("onset_q").isNull()
    return per_group.groupBy(*names).agg(
        (F.sum("p_sum") / F.sum("n")).alias("mean_p"), F.max("p_max").alias("max_p"), (F.sum("alerts") / F.sum("n")).alias("alert_rate"), F.count("onset_q").alias("onsets"),
        F.coalesce(F.try_divide(F.count("lag"), F.count("onset_q")), F.lit(0.0)).alias("onset_rate"), F.avg("lag").alias("mean_lag"),
        F.coalesce(F.try_divide(F.sum(F.when(quiet, F.col("sampled_alerts"))), F.sum(F.when(quiet, F.col("sampled")))), F.lit(0.0)).alias("false_alarm_rate"),
    )


def label_disputes(rows: DataFrame, keys: list[str], p: str = "probability", y: str = "is_onset", magnitude: str = "magnitude", threshold: float = 0.7, share: float = 0.9, k: int = 50) -> DataFrame:
    """A label review queue: the k strongest false positives, false negatives whose magnitude reaches the quantile `share`, and
    quarters that a single probability flags but persistence doesn't, with their kind and worth."""
    flagged = persistent(rows, keys, p, threshold)
    cut = rows.agg(F.percentile(magnitude, F.lit(share)).alias("cut"))
    single = F.col(p) >= threshold
    kinds = F.array_compact(F.array(
        F.when(single & (F.col(y) == 0), F.struct(F.lit("false_positive").alias("kind"), F.col(p).cast("double").alias("worth"))),
        F.when(~single & (F.col(y) == 1) & (F.col(magnitude) >= F.col("cut")), F.struct(F.lit("false_negative").alias("kind"), F.col(magnitude).cast("double").alias("worth"))),
        F.when(single & ~F.col("persistent"), F.struct(F.lit("not_persistent").alias("kind"), F.col(p).cast("double").alias("worth"))),
    ))
    queue = flagged.crossJoin(F.broadcast(cut)).select(*keys, "q_idx", F.explode(kinds).alias("d")).select(*keys, "q_idx", "d.*")  # one row
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("worth"), *keys, "q_idx"))
    return queue.withColumn("place", place).where((F.col("kind") != "false_positive") | (F.col("place") <= k))
