"""Citation and bibliographic-coupling graphs as edge tables. "The graph at quarter q" is a filter on valid_from_q."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio


def citation_edges(works: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst, valid_from_q) of references between works of the corpus; no loops, no repeated edges.

    An edge exists from the later quarter of its ends on, so one table replaces a graph for each quarter.
    """
    ends = works.select("work_id", "q_idx")
    pairs = refs.select(F.col("work_id").alias("src"), F.col("ref_id").alias("dst")).where("src <> dst").distinct()
    pairs = pairs.join(ends.select(F.col("work_id").alias("src"), F.col("q_idx").alias("src_q")), "src")
    pairs = pairs.join(ends.select(F.col("work_id").alias("dst"), F.col("q_idx").alias("dst_q")), "dst")
    return pairs.select("src", "dst", F.greatest("src_q", "dst_q").alias("valid_from_q"))


def shared_references(refs: DataFrame, min_shared: int = 5, block: int = 1024) -> DataFrame:
    """(node_a, node_b, shared_refs) for pairs a < b of works that share min_shared references or more.

    References that one work alone has go before the self-join. The citers of a popular reference are dealt into blocks of about
    `block` works, and every pair of its blocks is a join key of its own, so no task has more than a block's pairs to make; which
    pairs come out is not changed.
    """
    pairs = refs.select("work_id", "ref_id").distinct()
    popular = pairs.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ref_id", F.ceil(F.col("n") / block).alias("blocks"))
    kept = pairs.join(popular, "ref_id").withColumn("own", F.pmod(F.xxhash64("work_id"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = kept.select("ref_id", F.col("own").alias("i"), other.alias("j"), F.col("work_id").alias("node_a"))
    right = kept.select("ref_id", other.alias("i"), F.col("own").alias("j"), F.col("work_id").alias("node_b"))
    both = left.join(right, ["ref_id", "i", "j"]).where("node_a < node_b")
    return both.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("shared_refs")).where(F.col("shared_refs") >= min_shared)


def coupling_scores(refs: DataFrame, min_shared: int = 5, min_score: float = 0.25) -> DataFrame:
    """shared / sqrt(refs of a * refs of b) on distinct reference sets, at least min_score."""
    sizes = refs.select("work_id", "ref_id").distinct().groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = shared_references(refs, min_shared)
    pairs = pairs.join(sizes.select(F.col("work_id").alias("node_a"), F.col("n").alias("ref_count_a")), "node_a")
    pairs = pairs.join(sizes.select(F.col("work_id").alias("node_b"), F.col("n").alias("ref_count_b")), "node_b")
    score = F.col("shared_refs") / F.sqrt(F.col("ref_count_a").cast("double") * F.col("ref_count_b"))
    return pairs.withColumn("coupling_score", score).where(F.col("coupling_score") >= min_score)


def coupling_weights(scores: DataFrame, works: DataFrame, beta: float = 0.3, decay: float = 0.15, max_years: int = 5) -> DataFrame:
    """beta * score * exp(-decay * years apart); pairs further apart than max_years go, a missing year counts as none apart."""
    year = works.select("work_id", "pub_year")
    pairs = scores.join(year.select(F.col("work_id").alias("node_a"), F.col("pub_year").alias("year_a")), "node_a", "left")
    pairs = pairs.join(year.select(F.col("work_id").alias("node_b"), F.col("pub_year").alias("year_b")), "node_b", "left")
    apart = F.coalesce(F.abs(F.col("year_a") - F.col("year_b")), F.lit(0))
    return pairs.withColumn("years_apart", apart).where(apart <= max_years).withColumn("weight_coupling", beta * F.col("coupling_score") * F.exp(-decay * apart))


def hybrid_edges(citations: DataFrame, coupling: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Citation edges and both directions of coupling pairs in one table; where both exist the edge is hybrid and weights add."""
    both = coupling.select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), "weight_coupling").union(coupling.select("node_b", "node_a", "weight_coupling"))
    cites = citations.select("src", "dst").withColumn("weight_citation", F.lit(alpha))
    joined = cites.join(both, ["src", "dst"], "outer")
    kind = F.when(F.col("weight_coupling").isNull(), "citation").when(F.col("weight_citation").isNull(), "coupling").otherwise("hybrid")
    a, b = F.coalesce("weight_citation", F.lit(0.0)), F.coalesce("weight_coupling", F.lit(0.0))
    return joined.select("src", "dst", a.alias("weight_citation"), b.alias("weight_coupling"), (a + b).alias("weight_total"), kind.alias("edge_type"))


def edge_stats(edges: DataFrame) -> DataFrame:
    """Number and sum, mean, least and greatest total weight by edge type."""
    w = F.col("weight_total")
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.sum(w).alias("weight_sum"), F.avg(w).alias("weight_mean"), F.min(w).alias("weight_min"), F.max(w).alias("weight_max"))


def coupling_sensitivity(scores: DataFrame, works: DataFrame, betas: list[float], decays: list[float], max_years: int = 5) -> DataFrame:
    """Statistics of the weights for every (beta, decay), in one pass: each pair is exploded to the few settings."""
    base = coupling_weights(scores, works, 1.0, 0.0, max_years)
    grid = F.array(*[F.struct(F.lit(b).alias("beta"), F.lit(d).alias("decay")) for b in betas for d in decays])
    rows = base.withColumn("p", F.explode(grid)).select(F.col("p.beta").alias("beta"), F.col("p.decay").alias("decay"), "years_apart", (F.col("p.beta") * F.col("coupling_score") * F.exp(-F.col("p.decay") * F.col("years_apart"))).alias("w"))
    return rows.groupBy("beta", "decay").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("w").alias("w_sum"), F.avg("w").alias("w_mean"), F.stddev_pop("w").alias("w_std"), F.min("w").alias("w_min"), F.max("w").alias("w_max"),
        F.percentile("w", F.lit(0.95)).alias("w_p95"), F.percentile("years_apart", F.lit(0.5)).alias("median_years"),
    )


def nodes_at(works: DataFrame, q: int, scope: str = "cumulative") -> DataFrame:
    """Works of the graph at quarter q: cumulative (up to q), delta (of q) or annual (up to the end of q's year)."""
    limit = {"cumulative": F.col("q_idx") <= q, "delta": F.col("q_idx") == q, "annual": F.floor(F.col("q_idx") / 4) <= q // 4}
    return works.where(limit[scope])


def edges_at(edges: DataFrame, works: DataFrame, q: int, scope: str = "cumulative") -> DataFrame:
    """Edges of the graph at quarter q: both ends are among its works. For cumulative and annual scopes that is a filter on valid_from_q."""
    if scope == "cumulative":
        return edges.where(F.col("valid_from_q") <= q)
    if scope == "annual":
        return edges.where(F.floor(F.col("valid_from_q") / 4) <= q // 4)
    own = nodes_at(works, q, scope).select("work_id")
    return edges.where(F.col("valid_from_q") == q).join(own.withColumnRenamed("work_id", "src"), "src", "left_semi").join(own.withColumnRenamed("work_id", "dst"), "dst", "left_semi")


def size_bounds(stats: DataFrame, least: int = 10, most: int = 15000, min_share: float = 0.0005, sparse_degree: float = 15.0) -> DataFrame:
    """Bounds of community sizes that follow each quarter's graph (nodes, avg_degree): wider the larger, and with a floor where it is dense."""
    n = F.col("nodes")
    low = F.greatest(F.lit(least), F.ceil(n * F.lit(min_share)))
    sparse = F.least(F.lit(most), F.ceil(n * F.lit(0.05)))
    floor, ceiling = F.greatest(F.lit(10), F.ceil(n * F.lit(0.02))), F.least(F.lit(15000), F.ceil(n * F.lit(0.10)))
    high = F.when(F.col("avg_degree") < sparse_degree, sparse).otherwise(F.least(F.greatest(F.lit(most), floor), ceiling))
    return stats.select("q_idx", "nodes", "avg_degree", low.cast("long").alias("size_min"), high.cast("long").alias("size_max"))


def window_and_prune(works: DataFrame, edges: DataFrame, q: int, window: int | None = None, max_age_years: int | None = None, min_in_degree: int = 0) -> DataFrame:
    """Works of the last `window` quarters up to q; of works older than max_age_years only those cited more than min_in_degree times."""
    kept = works.where(F.col("q_idx") <= q)
    if window:
        kept = kept.where(F.col("q_idx") > q - window)
    if max_age_years is None:
        return kept
    degree = edges.where(F.col("valid_from_q") <= q).groupBy(F.col("dst").alias("work_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    joined = kept.join(degree, "work_id", "left")
    old = F.lit(q) - F.col("q_idx") > 4 * max_age_years
    return joined.where(~(old & (F.coalesce("in_degree", F.lit(0)) <= min_in_degree))).drop("in_degree")


def graph_stats_by_quarter(works: DataFrame, edges: DataFrame) -> DataFrame:
    """For each quarter's cumulative graph: nodes, edges, density, average degree and the share of isolated nodes.

    One pass: nodes, edges and first connections are counted at the quarter they begin and summed up over quarters.
    """
    ends = edges.select(F.col("src").alias("work_id"), "valid_from_q").union(edges.select("dst", "valid_from_q"))
    linked = ends.groupBy("work_id").agg(F.min("valid_from_q").alias("q_idx"))
    begun = (
        works.groupBy("q_idx").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("c"))
        .unionAll(edges.groupBy(F.col("valid_from_q").alias("q_idx")).agg(F.lit(0).cast("long"), F.count(F.lit(1)), F.lit(0).cast("long")))
        .unionAll(linked.groupBy("q_idx").agg(F.lit(0).cast("long"), F.lit(0).cast("long"), F.count(F.lit(1))))
    )
    quarters = begun.groupBy("q_idx").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("c").alias("c"))
    upto = Window.orderBy("q_idx").rowsBetween(Window.unboundedPreceding, 0)  # one row for each quarter
    total = quarters.select("q_idx", *[F.sum(c).over(upto).alias(c) for c in ("n", "m", "c")])
    n = F.col("n")
    return total.select(
        "q_idx", n.alias("nodes"), F.col("m").alias("edges"), ratio(F.col("m"), n * (n - 1)).alias("density"), ratio(F.col("m"), n).alias("avg_degree"), ratio(n - F.col("c"), n).alias("isolated_share"),
    )


def regime_start(stats: DataFrame, min_density: float, min_degree: float) -> DataFrame:
    """The first quarters whose density, and whose average degree, reach a threshold (null: none does)."""
    return stats.agg(F.min(F.when(F.col("density") >= min_density, F.col("q_idx"))).alias("density_from_q"), F.min(F.when(F.col("avg_degree") >= min_degree, F.col("q_idx"))).alias("degree_from_q"))
