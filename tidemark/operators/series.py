"""Quarterly series of lineages and fronts: rollups, dense grids, growth, lifecycle and context features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ordered, ratio, so_far, trailing


def rollup_fronts(series: DataFrame, mapping: DataFrame) -> DataFrame:
    """(front, q_idx, count, cumulative): new works of a front's lineages; lineages without a front go."""
    counts = series.join(mapping.select("lineage_id", "front"), "lineage_id").groupBy("front", "q_idx").agg(F.sum("new_works").alias("count"))
    return counts.withColumn("cumulative", F.sum("count").over(so_far(["front"], "q_idx")))


def wide(series: DataFrame, key: str, value: str, names: list[str], fill_forward: bool = False) -> DataFrame:
    """One row for each quarter, one column for each name; gaps are 0, or the last value before."""
    out = series.groupBy("q_idx").pivot(key, names).agg(F.sum(value))
    w = Window.orderBy("q_idx").rowsBetween(Window.unboundedPreceding, 0)  # one row for each quarter
    cell = lambda n: F.last(F.col(f"`{n}`"), True).over(w) if fill_forward else F.col(f"`{n}`")
    return out.select("q_idx", *[F.coalesce(cell(n), F.lit(0)).alias(n) for n in names])


def long(table: DataFrame, names: list[str], key: str = "front", value: str = "count") -> DataFrame:
    return table.unpivot(["q_idx"], names, key, value)


def densify(series: DataFrame, keys: list[str], value: str = "new_works", whole_range: bool = False) -> DataFrame:
    """A row for every quarter between a group's first and last (whole_range: between all groups'), missing ones 0, duplicates summed; place from 0."""
    sums = series.groupBy(*keys, "q_idx").agg(F.sum(value).alias(value))
    ends = sums.groupBy(*keys).agg(F.min("q_idx").alias("lo"), F.max("q_idx").alias("hi"))
    if whole_range:
        every = Window.partitionBy()  # one row for each group
        ends = ends.withColumns({"lo": F.min("lo").over(every), "hi": F.max("hi").over(every)})
    grid = ends.select(*keys, F.explode(F.sequence("lo", "hi")).alias("q_idx"))
    dense = grid.join(sums, [*keys, "q_idx"], "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))
    return dense.withColumn("place", F.row_number().over(ordered(keys, "q_idx")) - 1)


def growth_features(series: DataFrame, keys: list[str], value: str = "new_works") -> DataFrame:
    """Difference, acceleration, year-on-year delta and ratio, rolling means and deviation (samples), running total."""
    w, x = ordered(keys, "q_idx"), F.col(value)
    out = series.withColumns({
        "delta": F.coalesce(x - F.lag(x).over(w), F.lit(0)), "yoy_delta": F.coalesce(x - F.lag(x, 4).over(w), F.lit(0)), "yoy_ratio": ratio(x, F.lag(x, 4).over(w)),
        "roll_mean_2": F.avg(x).over(trailing(keys, "q_idx", 2)), "roll_mean_4": F.avg(x).over(trailing(keys, "q_idx", 4)),
        "roll_std_4": F.coalesce(F.stddev_samp(x).over(trailing(keys, "q_idx", 4)), F.lit(0.0)), "cumulative": F.sum(x).over(so_far(keys, "q_idx")),
    })
    return out.withColumn("acceleration", F.coalesce(F.col("delta") - F.lag("delta").over(w), F.lit(0)))


def seasonal_context(series: DataFrame, keys: list[str], value: str = "new_works") -> DataFrame:
    """Rolling year's mean and sum, running total and its logarithm, year-on-year delta and percentage where the year before is positive."""
    w, x = ordered(keys, "q_idx"), F.col(value)
    prev = F.lag(x, 4).over(w)
    out = series.withColumns({"year_mean": F.avg(x).over(trailing(keys, "q_idx", 4)), "year_sum": F.sum(x).over(trailing(keys, "q_idx", 4)), "cumulative": F.sum(x).over(so_far(keys, "q_idx"))})
    return out.withColumns({"log_cumulative": F.log1p("cumulative"), "yoy_delta": x - prev, "yoy_pct": F.when(prev > 0, (x - prev) / prev)})


def dormancy(series: DataFrame, keys: list[str], value: str = "new_works") -> DataFrame:
    """Quarters without works right before each one, and the awakening: value * max(streak, 1) where value is positive."""
    w = ordered(keys, "q_idx")
    placed = series.withColumn("row_", F.row_number().over(w))
    last = F.max(F.when(F.col(value) > 0, F.col("row_"))).over(so_far(keys, "q_idx", -1))
    streak = placed.withColumn("streak", F.col("row_") - 1 - F.coalesce(last, F.lit(0))).drop("row_")
    return streak.withColumn("awakening", F.when(F.col(value) > 0, F.col(value) * F.greatest("streak", F.lit(1))).otherwise(0))


def context_features(metric: DataFrame, value: str = "value") -> DataFrame:
    """Of a global metric by quarter: z over all quarters (population), difference, rolling means 1, 2, 4, and distance to the year's extremes."""
    w, x = Window.orderBy("q_idx"), F.col(value)  # one row for each quarter
    every, year = Window.partitionBy(), w.rowsBetween(-3, 0)
    return metric.select(
        "q_idx", ratio(x - F.avg(x).over(every), F.stddev_pop(x).over(every)).alias("z"), F.coalesce(x - F.lag(x).over(w), F.lit(0.0)).alias("qoq"), x.alias("roll_1"), F.avg(x).over(w.rowsBetween(-1, 0)).alias("roll_2"),
        F.avg(x).over(year).alias("roll_4"), (F.max(x).over(year) - x).alias("below_max"), (x - F.min(x).over(year)).alias("above_min"),
    )


def field_relative(series: DataFrame, keys: list[str], value: str = "new_works") -> DataFrame:
    """Share of the quarter's total, ratio to its 75th percentile and difference to its mean."""
    field = series.groupBy("q_idx").agg(F.sum(value).alias("field_total"), F.percentile(value, F.lit(0.75)).alias("field_p75"), F.avg(value).alias("field_mean"))
    joined = series.join(field, "q_idx")
    return joined.select(*keys, "q_idx", ratio(F.col(value), F.col("field_total")).alias("field_share"), ratio(F.col(value), F.col("field_p75")).alias("p75_ratio"), (F.col(value) - F.col("field_mean")).alias("above_mean"))


def lifecycle(series: DataFrame, onsets: DataFrame, maturations: DataFrame, keys: list[str]) -> DataFrame:
    """pre_onset, growth, post_maturation or never_grew, and quarters since onset (null before)."""
    joined = series.select(*keys, "q_idx").join(onsets.select(*keys, "onset_q"), keys, "left").join(maturations.select(*keys, "maturation_q"), keys, "left")
    q = F.col("q_idx")
    stage = F.when(F.col("onset_q").isNull(), "never_grew").when(q < F.col("onset_q"), "pre_onset").when(q >= F.col("maturation_q"), "post_maturation").otherwise("growth")
    return joined.select(*keys, "q_idx", stage.alias("stage"), F.when(q >= F.col("onset_q"), q - F.col("onset_q")).alias("since_onset"))


def last_before(rows: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, q_idx) with the quarter of the last event strictly before and the quarters since: a union and one window, no range join."""
    marks = events.select(*keys, F.col("event_q").alias("q_idx"), F.col("event_q"), F.lit(1).alias("side_")).unionByName(rows.select(*keys, "q_idx").withColumns({"event_q": F.lit(None).cast("int"), "side_": F.lit(0)}))
    w = Window.partitionBy(*keys).orderBy("q_idx", "side_").rowsBetween(Window.unboundedPreceding, -1)  # rows of a quarter come before its events
    found = marks.withColumn("last_event_q", F.last("event_q", True).over(w)).where("side_ = 0")
    return found.select(*keys, "q_idx", "last_event_q", (F.col("q_idx") - F.col("last_event_q")).alias("quarters_since"))


def nearest_event(rows: DataFrame, events: DataFrame, keys: list[str], label: str = "event_id") -> DataFrame:
    """rows (keys, q_idx) with the event of the least |q_idx - event_q|, ties to the earlier quarter, then label; lag and its bucket."""
    near = F.min_by(F.struct("event_q", label), F.struct(F.abs(F.col("q_idx") - F.col("event_q")), "event_q", label))
    joined = rows.join(events.select(*keys, "event_q", label), keys, "left").groupBy(*keys, "q_idx").agg(F.when(F.count("event_q") > 0, near).alias("e"))
    lag = F.col("q_idx") - F.col("e.event_q")
    return joined.select(*keys, "q_idx", F.col(f"e.{label}").alias(label), lag.alias("lag"), lag_bucket(lag).alias("bucket"))


def lag_bucket(lag: Column) -> Column:
    a = F.abs(lag)
    return F.when(lag.isNull(), "no_milestone").when(a < 4, "<4q").when(a < 8, "4-8q").when(a < 12, "8-12q").otherwise(">=12q")


def front_series(series: DataFrame, mapping: DataFrame) -> DataFrame:
    """Dense front series with growth, acceleration, rolling mean and deviation (population), year-on-year growth and active lineages so far."""
    named = series.join(mapping.select("lineage_id", "front"), "lineage_id")
    dense = densify(named, ["front"], whole_range=True)
    w, x = ordered(["front"], "q_idx"), F.col("new_works")
    prev, year = F.lag(x).over(w), F.lag(x, 4).over(w)
    first = named.where("new_works > 0").groupBy("front", "lineage_id").agg(F.min("q_idx").alias("q_idx")).groupBy("front", "q_idx").agg(F.count(F.lit(1)).alias("arrived"))
    out = dense.join(first, ["front", "q_idx"], "left").withColumns({
        "growth": F.coalesce((x - prev) / F.greatest(prev, F.lit(1)), F.lit(0.0)), "roll_mean_4": F.avg(x).over(trailing(["front"], "q_idx", 4)), "roll_std_4": F.stddev_pop(x).over(trailing(["front"], "q_idx", 4)),
        "yoy": F.coalesce((x - year) / F.greatest(year, F.lit(1)), F.lit(0.0)), "lineages_so_far": F.sum(F.coalesce("arrived", F.lit(0))).over(so_far(["front"], "q_idx")),
    })
    return out.withColumn("acceleration", F.coalesce(F.col("growth") - F.lag("growth").over(w), F.lit(0.0))).drop("arrived", "place")


def decline_streaks(series: DataFrame, keys: list[str], value: str = "new_works") -> DataFrame:
    """Length of the run of falling quarters that ends at each quarter (0: not falling): islands between quarters that don't fall."""
    w, x = ordered(keys, "q_idx"), F.col(value)
    falling = F.coalesce((x < F.lag(x).over(w)).cast("int"), F.lit(0))
    marked = series.withColumn("falling_", falling)
    island = marked.withColumn("island_", F.sum(1 - F.col("falling_")).over(so_far(keys, "q_idx")))
    run = F.sum("falling_").over(Window.partitionBy(*keys, "island_").orderBy("q_idx"))
    return island.select(*keys, "q_idx", run.alias("decline_streak"))


def front_lifecycle(fronts: DataFrame, onsets: DataFrame, mapping: DataFrame, growth_window: int = 12, decline: int = 4) -> DataFrame:
    """Stage of each front and quarter of front_series: no_onset, pre_onset, growth for growth_window quarters, then decline where the
    rolling mean has fallen for `decline` quarters, else mature. A front's onset is the earliest among its lineages."""
    known = onsets.join(mapping.select("lineage_id", "front"), "lineage_id").groupBy("front").agg(F.min("onset_q").alias("onset_q"), F.count("onset_q").alias("onset_lineages"))
    falls = decline_streaks(fronts, ["front"], "roll_mean_4")
    joined = fronts.select("front", "q_idx").join(falls, ["front", "q_idx"]).join(known, "front", "left")
    since = F.col("q_idx") - F.col("onset_q")
    stage = F.when(F.col("onset_q").isNull(), "no_onset").when(since < 0, "pre_onset").when(since <= growth_window, "growth").when(F.col("decline_streak") >= decline, "decline").otherwise("mature")
    return joined.withColumns({"since_onset": F.when(since >= 0, since), "stage": stage})


def field_from_lineages(series: DataFrame, value: Column, weight: Column) -> DataFrame:
    """Weighted mean (weights null or 0 count as 1), simple mean and median of a lineage value by quarter."""
    w = F.when(F.coalesce(weight, F.lit(0)) == 0, 1).otherwise(weight)
    rows = series.select("q_idx", value.alias("v"), w.alias("w"))
    return rows.groupBy("q_idx").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("weighted_mean"), F.avg("v").alias("simple_mean"), F.median("v").alias("median"))


def outlier_report(features: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, nulls, share outside 3 interquartile ranges and share of |z| > 5."""
    long_form = features.select(F.lit(0).alias("q_idx"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["q_idx"], columns, "feature", "v")
    stats = long_form.groupBy("feature").agg(F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.75)).alias("q3"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    far = (F.col("v") < F.col("q1") - 3 * (F.col("q3") - F.col("q1"))) | (F.col("v") > F.col("q3") + 3 * (F.col("q3") - F.col("q1")))
    z = F.abs(ratio(F.col("v") - F.col("m"), F.col("s"))) > 5
    return long_form.join(stats, "feature").groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.avg(far.cast("double")).alias("iqr_share"), F.avg(z.cast("double")).alias("z_share"))
