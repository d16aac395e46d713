"""Scientometric context metrics, one row for each quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio, so_far
from tidemark.functions.quarters import quarter_end


def author_influx(authorships: DataFrame) -> DataFrame:
    """Distinct authors of each quarter, those not seen before, returning ones, the rate of new ones and their running total.

    authorships: (author_id, q_idx). An author is new in the least of its quarters, so no set is carried along.
    """
    pairs = authorships.where("author_id IS NOT NULL").select("author_id", "q_idx").distinct()
    first = pairs.groupBy("author_id").agg(F.min("q_idx").alias("first_q"))
    active = pairs.groupBy("q_idx").agg(F.count(F.lit(1)).alias("authors"))
    new = first.groupBy(F.col("first_q").alias("q_idx")).agg(F.count(F.lit(1)).alias("new_authors"))
    joined = active.join(new, "q_idx", "left").withColumn("new_authors", F.coalesce("new_authors", F.lit(0).cast("long")))
    upto = Window.orderBy("q_idx").rowsBetween(Window.unboundedPreceding, 0)  # one row for each quarter
    return joined.select("q_idx", "authors", "new_authors", (F.col("authors") - F.col("new_authors")).alias("returning"), ratio(F.col("new_authors"), F.col("authors")).alias("new_rate"), F.sum("new_authors").over(upto).alias("cumulative"))


def citation_velocity(works: DataFrame, fast: float = 5.0, min_age: float = 0.25) -> DataFrame:
    """Citations a year of age at the quarter's end: mean, median, 90th percentile, share of `fast` ones, share aged two years at most."""
    age = F.greatest(F.datediff(quarter_end(F.col("q_idx")), F.col("publication_date")) / F.lit(365.25), F.lit(0.0))
    v = works.withColumn("age", age).withColumn("velocity", F.col("cited_by_count") / F.greatest("age", F.lit(min_age)))
    return v.groupBy("q_idx").agg(
        F.count(F.lit(1)).alias("works"), F.avg("velocity").alias("mean"), F.median("velocity").alias("median"), F.percentile("velocity", F.lit(0.9)).alias("p90"),
        F.avg((F.col("velocity") >= fast).cast("double")).alias("fast_share"), F.avg((F.col("age") <= 2).cast("double")).alias("young_share"),
    )


def top_by_velocity(works: DataFrame, k: int = 5, min_age: float = 0.25) -> DataFrame:
    """The k works of a quarter with most citations a year; ties by id."""
    age = F.greatest(F.datediff(quarter_end(F.col("q_idx")), F.col("publication_date")) / F.lit(365.25), F.lit(min_age))
    v = works.withColumn("velocity", F.col("cited_by_count") / age)
    place = F.row_number().over(Window.partitionBy("q_idx").orderBy(F.desc("velocity"), "work_id"))
    return v.withColumn("place", place).where(F.col("place") <= k).select("q_idx", "place", "work_id", "velocity")


def reference_vitality(works: DataFrame, refs: DataFrame, young: float = 3.0, old: float = 10.0) -> DataFrame:
    """Age of the references that are in the corpus and not younger than their work: 1 / (age + 1) as score, shares of young and old.

    share_recent is the young references' part of all scores.
    """
    day = works.select("work_id", "publication_date", "q_idx")
    cited = day.select(F.col("work_id").alias("ref_id"), F.col("publication_date").alias("ref_date"))
    pairs = refs.join(day, "work_id").join(cited, "ref_id")
    age = F.datediff("publication_date", "ref_date") / F.lit(365.25)
    pairs = pairs.withColumn("age", age).where("age >= 0").withColumn("score", 1 / (F.col("age") + 1))
    recent = F.sum(F.when(F.col("age") <= young, F.col("score")).otherwise(0.0))
    return pairs.groupBy("q_idx").agg(
        F.count(F.lit(1)).alias("references"), F.countDistinct("work_id").alias("works_with_refs"), F.avg("score").alias("vitality"), F.avg("age").alias("mean_age"), F.median("age").alias("median_age"),
        F.avg((F.col("age") <= young).cast("double")).alias("young_share"), F.avg((F.col("age") >= old).cast("double")).alias("old_share"), ratio(recent, F.sum("score")).alias("share_recent"),
    )


def topic_diversity(works: DataFrame, topic_col: str = "topic", k: int = 5) -> DataFrame:
    """Shannon entropy (nats), its exponential, the Herfindahl index, its complement and the share of the k largest topics."""
    counts = works.groupBy("q_idx", topic_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("q_idx"))
    place = F.row_number().over(Window.partitionBy("q_idx").orderBy(F.desc("n"), topic_col))
    p = counts.withColumn("p", F.col("n") / total).withColumn("place", place)
    sums = p.groupBy("q_idx").agg(F.count(F.lit(1)).alias("topics"), (-F.sum(F.col("p") * F.log("p"))).alias("shannon"), F.sum(F.col("p") ** 2).alias("hhi"), F.sum(F.when(F.col("place") <= k, F.col("p")).otherwise(0.0)).alias("top_share"))
    return sums.select("q_idx", "topics", "shannon", F.exp("shannon").alias("effective"), "hhi", (1 - F.col("hhi")).alias("simpson"), "top_share")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def bridging_nodes(edges: DataFrame, partition: DataFrame, min_degree: int = 3) -> DataFrame:
    """Degree, external degree and their ratio of nodes with min_degree neighbours or more; only edges between assigned nodes count."""
    e = undirected(edges)
    c = partition.select("work_id", "community_id")
    joined = e.join(c.select(F.col("work_id").alias("a"), F.col("community_id").alias("ca")), "a").join(c.select(F.col("work_id").alias("b"), F.col("community_id").alias("cb")), "b")
    cross = (F.col("ca") != F.col("cb")).cast("long").alias("cross")
    ends = joined.select(F.col("a").alias("work_id"), cross).union(joined.select(F.col("b"), cross))
    nodes = ends.groupBy("work_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("cross").alias("external"))
    return nodes.where(F.col("degree") >= min_degree).withColumn("bridging", F.col("external") / F.col("degree"))


def bridging_summary(nodes: DataFrame, high: float = 0.5) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.avg("bridging").alias("mean"), F.median("bridging").alias("median"), F.percentile("bridging", F.lit(0.9)).alias("p90"), F.avg((F.col("bridging") >= high).cast("double")).alias("high_share"))


def field_metrics(series: DataFrame) -> DataFrame:
    """Per quarter: total, mean, median, quantiles, active lineages, running total, rolling means and deviation, differences, seasonal baseline."""
    agg = series.groupBy("q_idx").agg(
        F.sum("new_works").alias("total"), F.avg("new_works").alias("mean"), F.median("new_works").alias("median"), F.count(F.lit(1)).alias("active"),
        *[F.percentile("new_works", F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.5, 0.75, 0.9)],
    )
    w = Window.orderBy("q_idx")  # one row for each quarter
    rows = lambda k: w.rowsBetween(1 - k, 0)
    season = F.pmod(F.col("q_idx"), F.lit(4))
    out = agg.withColumns({
        "cumulative": F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "roll_mean_2": F.avg("total").over(rows(2)), "roll_mean_4": F.avg("total").over(rows(4)), "roll_std_4": F.coalesce(F.stddev_samp("total").over(rows(4)), F.lit(0.0)),
        "delta": F.col("total") - F.lag("total").over(w), "yoy_delta": F.col("total") - F.lag("total", 4).over(w), "yoy_ratio": ratio(F.col("total"), F.lag("total", 4).over(w)),
        "seasonal_median": F.median("total").over(Window.partitionBy(season)),
    })
    growth = ratio(F.col("cumulative"), F.lag("cumulative").over(w), None) - 1
    out = out.withColumns({"cum_growth": F.coalesce(growth, F.lit(0.0)), "seasonal_adjusted": F.col("total") - F.col("seasonal_median")})
    return out.withColumn("acceleration", F.coalesce(F.col("cum_growth") - F.lag("cum_growth").over(w), F.lit(0.0)))


def first_seen(df: DataFrame, keys: list[str], element: str, order: str = "q_idx") -> DataFrame:
    """New and distinct elements of each (keys, order): an element is new in the least order of its group."""
    pairs = df.select(*keys, order, element).distinct()
    first = F.min(order).over(Window.partitionBy(*keys, element))
    marked = pairs.withColumn("is_new", (F.col(order) == first).cast("long"))
    sums = marked.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("distinct_elements"), F.sum("is_new").alias("new_elements"))
    return sums.withColumn("novelty_rate", ratio(F.col("new_elements"), F.col("distinct_elements"))).withColumn("seen_so_far", F.sum("new_elements").over(so_far(keys, order)))
