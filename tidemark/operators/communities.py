"""Communities of quarterly graphs and their lineages over time, as tables (quarter, work_id, community_id)."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators import partitions as P
from tidemark.sources.stages import dropped, written


def _large(rows: DataFrame) -> DataFrame:
    """rows, never to be broadcast: the optimiser's size of works exploded over quarters leaves out what the explode adds."""
    return rows.hint("merge")


def edges_by_quarter(edges: DataFrame, quarters: list[int]) -> DataFrame:
    """The cumulative graph of each asked quarter, as one table with the quarter as key."""
    at = F.filter(F.array(*[F.lit(q) for q in quarters]).cast("array<int>"), lambda q: q >= F.col("valid_from_q"))
    weight = F.col("weight_total") if "weight_total" in edges.columns else F.lit(1.0)
    return edges.select(F.explode(at).alias("q_idx"), "src", "dst", weight.cast("double").alias("weight"))


def _indexed(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
    return names, np.searchsorted(names, src).astype(np.int32), np.searchsorted(names, dst).astype(np.int32)


def detect_communities(quarterly: DataFrame, resolution: float = 0.001, least: int = 10, most: int = 15000, runs: int = 0, seed: int = 42) -> DataFrame:
    """(q_idx, work_id, community_id, modularity) of each quarter's graph; communities outside [least, most] members go.

    runs > 0 takes the consensus of so many seeded runs. Quarters are independent groups; one quarter's graph must fit into
    one task's memory, as its local moves are sequential. For larger graphs see label_propagation.
    """
    kind = quarterly.schema["src"].dataType.simpleString()

    def cluster(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        names, a, b = _indexed(group["src"].to_numpy(), group["dst"].to_numpy())
        order = np.lexsort((b, a))
        near = P.symmetric(a[order], b[order], group["weight"].to_numpy()[order], len(names))
        del a, b, order
        label = P.consensus_communities(near, resolution, runs, seed=seed) if runs else P.potts_communities(near, resolution, seed)
        size = np.bincount(label)
        kept = np.flatnonzero((size[label] >= least) & (size[label] <= most))
        # communities are numbered by their least member
        first, number = np.unique(label[kept], return_index=True, return_inverse=True)[1:]
        place = np.empty(len(first), dtype=np.int64)
        place[np.argsort(first)] = np.arange(len(first))
        q, value = np.full(len(kept), key[0].as_py(), dtype=np.int32), np.full(len(kept), P.modularity(near, label))
        out = pa.table([pa.array(q), pa.array(names[kept]), pa.array(place[number], pa.int64()), pa.array(value)], ["q_idx", "work_id", "community_id", "modularity"])
        del near, label, names
        pa.default_memory_pool().release_unused()  # idle workers stay beside the next group's
        return out

    return quarterly.groupBy("q_idx").applyInArrow(cluster, f"q_idx int, work_id {kind}, community_id long, modularity double")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(work_id, community_id) for graphs too large for one task: each node takes the heaviest label around it, ties to the least.

    A round is one join and one aggregate; the table of labels is written out after every round, which cuts the lineage.
    """
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "links")
    labels = both.select(F.col("src").alias("work_id")).distinct().withColumn("community_id", F.col("work_id"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("dst") == F.col("work_id")).groupBy("src", "community_id").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.max_by("community_id", F.struct("n", (-F.col("community_id")).alias("least"))).alias("community_id"))
        labels = written(best.withColumnRenamed("src", "work_id"), "labels")
    return labels


def pagerank_by_joins(quarterly: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """(q_idx, work_id, rank) of the graphs of all quarters at once, for graphs too large for one task.

    A round is one join of edges with ranks, one aggregate and one join back; its ranks are written out, which ends the lineage, and
    the change of each quarter is all that the driver sees. Out-edges are uniform, dangling mass is spread evenly.
    """
    edges = quarterly.select("q_idx", "src", "dst").distinct()
    degree = edges.groupBy("q_idx", "src").agg(F.count(F.lit(1)).alias("out"))
    edges = written(edges.join(degree, ["q_idx", "src"]), "edges")
    nodes = edges.select("q_idx", F.col("src").alias("work_id")).union(edges.select("q_idx", "dst")).distinct()
    nodes = nodes.join(degree.withColumnRenamed("src", "work_id"), ["q_idx", "work_id"], "left").withColumn("dangling", F.col("out").isNull()).drop("out")
    sizes = nodes.groupBy("q_idx").agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row for each quarter
    ranks = written(nodes.join(sizes, "q_idx").withColumn("rank", 1 / F.col("n")).withColumn("before", F.lit(0.0)), "ranks")
    for _ in range(rounds):
        given = edges.join(ranks.select("q_idx", F.col("work_id").alias("src"), "rank"), ["q_idx", "src"])
        given = given.groupBy("q_idx", F.col("dst").alias("work_id")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        loose = ranks.groupBy("q_idx").agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("loose"))
        joined = ranks.join(loose, "q_idx").join(given, ["q_idx", "work_id"], "left")
        fresh = damping * (F.coalesce("given", F.lit(0.0)) + F.col("loose") / F.col("n")) + (1 - damping) / F.col("n")
        old, ranks = ranks, written(joined.select("q_idx", "work_id", "dangling", "n", fresh.alias("rank"), F.col("rank").alias("before")), "ranks")
        dropped(old)
        left = ranks.groupBy("q_idx").agg((F.sum(F.abs(F.col("rank") - F.col("before"))) < F.max("n") * tolerance).alias("done"))
        if not left.where("NOT done").limit(1).count():
            break
    return ranks.select("q_idx", "work_id", "rank")


def pagerank_cores(quarterly: DataFrame, partition: DataFrame, share: float = 0.1, by_joins: bool = False) -> DataFrame:
    """(q_idx, community_id, work_id, rank): the ceil(share * size) members of highest PageRank in the quarter's graph, ties by id.

    A quarter's graph is ranked in one task, which its edges must fit; by_joins ranks graphs of any size, in many rounds.
    """
    kind = quarterly.schema["src"].dataType.simpleString()

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        names, a, b = _indexed(group["src"].to_numpy(), group["dst"].to_numpy())
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        return pd.DataFrame({"q_idx": group["q_idx"].iloc[0], "work_id": names, "rank": P.pagerank(pairs[:, 0], pairs[:, 1], len(names))})

    ranks = pagerank_by_joins(quarterly) if by_joins else quarterly.groupBy("q_idx").applyInPandas(rank, f"q_idx int, work_id {kind}, rank double")
    ranked = ranks.join(_large(partition.select("q_idx", "work_id", "community_id")), ["q_idx", "work_id"])
    w = Window.partitionBy("q_idx", "community_id")
    placed = ranked.withColumns({"place": F.row_number().over(w.orderBy(F.desc(F.round("rank", 12)), "work_id")), "size": F.count(F.lit(1)).over(w)})
    return placed.where(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("size") * share))).select("q_idx", "community_id", "work_id", "rank")


def core_overlaps(cores: DataFrame, step: int = 1) -> DataFrame:
    """(q_idx, prev, curr, overlap, size_prev, size_curr) of cores `step` quarters apart that share works: one join for all quarters."""
    sizes = cores.groupBy("q_idx", "community_id").agg(F.count(F.lit(1)).alias("size"))
    before = cores.select((F.col("q_idx") + step).alias("q_idx"), F.col("community_id").alias("prev"), "work_id")
    pairs = cores.select("q_idx", F.col("community_id").alias("curr"), "work_id").join(_large(before), ["q_idx", "work_id"])
    pairs = pairs.groupBy("q_idx", "prev", "curr").agg(F.count(F.lit(1)).alias("overlap"))
    pairs = pairs.join(sizes.select((F.col("q_idx") + step).alias("q_idx"), F.col("community_id").alias("prev"), F.col("size").alias("size_prev")), ["q_idx", "prev"])
    return pairs.join(sizes.select("q_idx", F.col("community_id").alias("curr"), F.col("size").alias("size_curr")), ["q_idx", "curr"])


def match_cores(overlaps: DataFrame) -> DataFrame:
    """(q_idx, prev, curr, overlap) of the one-to-one matching of largest total overlap for each quarter."""

    def match(group: pd.DataFrame) -> pd.DataFrame:
        prev, i = np.unique(group["prev"], return_inverse=True)
        curr, j = np.unique(group["curr"], return_inverse=True)
        weight = np.zeros((len(prev), len(curr)))
        weight[i, j] = group["overlap"]
        rows = [(int(group["q_idx"].iloc[0]), int(prev[a]), int(curr[b]), int(weight[a, b])) for a, b in P.best_assignment(weight)]
        return pd.DataFrame(rows, columns=["q_idx", "prev", "curr", "overlap"])

    return overlaps.select("q_idx", "prev", "curr", "overlap").groupBy("q_idx").applyInPandas(match, "q_idx int, prev long, curr long, overlap long")


def overlap_events(overlaps: DataFrame, least: int = 10, share: float = 0.1) -> DataFrame:
    """Splits (a previous core with several current ones) and merges (a current core with several previous ones) of strong overlaps."""
    strong = overlaps.where((F.col("overlap") >= least) & (ratio(F.col("overlap"), F.least("size_prev", "size_curr")) >= share))
    split = strong.groupBy("q_idx", F.col("prev").alias("community_id")).agg(F.countDistinct("curr").alias("partners")).withColumn("event", F.lit("split"))
    merge = strong.groupBy("q_idx", F.col("curr").alias("community_id")).agg(F.countDistinct("prev").alias("partners")).withColumn("event", F.lit("merge"))
    return split.unionByName(merge).where("partners > 1").select("q_idx", "event", "community_id", "partners")


def assign_lineages(partition: DataFrame, matches: DataFrame) -> DataFrame:
    """(q_idx, community_id, lineage_id): a matched community inherits, others get the next id by quarter and community id.

    The fold over quarters is sequential; it runs on the driver over community ids, a few for each quarter, not over works.
    """
    spark = partition.sparkSession
    alive = partition.select("q_idx", "community_id").distinct().orderBy("q_idx", "community_id").collect()
    inherited = {(r["q_idx"], r["curr"]): r["prev"] for r in matches.collect()}
    registry: dict[tuple[int, int], int] = {}
    following = 1
    for r in alive:
        key = (r["q_idx"], r["community_id"])
        lineage = registry.get((r["q_idx"] - 1, inherited[key])) if key in inherited else None
        if lineage is None:
            lineage, following = following, following + 1
        registry[key] = lineage
    return spark.createDataFrame([(q, c, l) for (q, c), l in registry.items()], "q_idx int, community_id long, lineage_id long")


def variation_of_information(a: DataFrame, b: DataFrame, by: list[str], node: str = "work_id", label: str = "community_id", union: bool = True) -> DataFrame:
    """VI in bits of two partitions for each group `by`, over the union of nodes (missing ones alone) or their intersection; n and normalised VI."""
    x = a.select(*by, F.col(node).alias("node"), F.concat(F.lit("a"), F.col(label).cast("string")).alias("x"))
    y = b.select(*by, F.col(node).alias("node"), F.concat(F.lit("b"), F.col(label).cast("string")).alias("y"))
    joined = x.join(y, [*by, "node"], "outer" if union else "inner")
    alone = F.concat(F.lit("only"), F.col("node").cast("string"))
    cells = joined.select(*by, F.coalesce("x", alone).alias("x"), F.coalesce("y", alone).alias("y")).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    sized = cells.withColumns({"total": F.sum("n").over(w), "nx": F.sum("n").over(w.partitionBy(*by, "x")), "ny": F.sum("n").over(Window.partitionBy(*by, "y"))})
    p = F.col("n") / F.col("total")
    vi = -F.sum(p * (F.log2(F.col("n") / F.col("nx")) + F.log2(F.col("n") / F.col("ny"))))
    out = sized.groupBy(*by).agg(vi.alias("vi"), F.max("total").alias("n_nodes"))
    return out.withColumn("vi", F.greatest("vi", F.lit(0.0))).withColumn("nvi", F.when(F.col("n_nodes") > 1, F.col("vi") / F.log2("n_nodes")).otherwise(0.0))


def core_overlap_summary(overlaps: DataFrame, registry: DataFrame, matches: DataFrame) -> DataFrame:
    """Per lineage and quarter: mean of overlap / smaller core, weighted by the smaller core, over its matched pairs."""
    kept = overlaps.join(matches.select("q_idx", "prev", "curr"), ["q_idx", "prev", "curr"])
    least = F.least("size_prev", "size_curr")
    named = kept.join(registry.select("q_idx", F.col("community_id").alias("curr"), "lineage_id"), ["q_idx", "curr"])
    return named.groupBy("lineage_id", "q_idx").agg(ratio(F.sum(F.col("overlap") / least * least), F.sum(least)).alias("core_overlap"))


def label_change_rate(assignments: DataFrame, step: int = 1) -> DataFrame:
    """Share of a lineage's works of a quarter that had another lineage `step` quarters before, among those that had one."""
    before = assignments.select("work_id", (F.col("q_idx") + step).alias("q_idx"), F.col("lineage_id").alias("before"))
    joined = assignments.join(_large(before), ["work_id", "q_idx"])
    return joined.groupBy("lineage_id", "q_idx").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg((F.col("before") != F.col("lineage_id")).cast("double")).alias("change_rate"))


def misfit_flags(edges: DataFrame, partition: DataFrame, min_links: int = 20, most_inside: float = 0.1) -> DataFrame:
    """Nodes with min_links out-neighbours in the partition: within share, silhouette and whether they are probably misassigned.

    On 0/1 dissimilarity the mean distance to an own cluster of size s is 1 - k / (s - 1), to another 1 - k / s; clusters
    without an edge have distance 1, so the nearest is found among those with one.
    """
    p = partition.select("work_id", "community_id")
    sizes = p.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    links = edges.select("src", "dst").where("src <> dst").distinct().join(p.select(F.col("work_id").alias("dst"), F.col("community_id").alias("to")), "dst")
    counts = links.join(p.select(F.col("work_id").alias("src"), F.col("community_id").alias("own")), "src").groupBy("src", "own", "to").agg(F.count(F.lit(1)).alias("k"))
    counts = counts.join(sizes.select(F.col("community_id").alias("to"), F.col("size").alias("to_size")), "to").join(sizes.select(F.col("community_id").alias("own"), F.col("size").alias("own_size")), "own")
    inside = F.sum(F.when(F.col("own") == F.col("to"), F.col("k")).otherwise(0))
    other = F.min(F.when(F.col("own") != F.col("to"), 1 - F.col("k") / F.col("to_size")))
    nodes = counts.groupBy(F.col("src").alias("work_id"), F.col("own").alias("community_id"), "own_size").agg(F.sum("k").alias("links"), inside.alias("inside"), F.coalesce(other, F.lit(1.0)).alias("b"))
    nodes = nodes.where(F.col("links") >= min_links).withColumn("a", F.when(F.col("own_size") > 1, 1 - F.col("inside") / (F.col("own_size") - 1)).otherwise(F.lit(0.0)))
    nodes = nodes.withColumns({"within_share": F.col("inside") / F.col("links"), "silhouette": F.when(F.col("own_size") > 1, ratio(F.col("b") - F.col("a"), F.greatest("a", "b"))).otherwise(0.0)})
    return nodes.select("work_id", "community_id", "links", "within_share", "silhouette", ((F.col("within_share") <= most_inside) & (F.col("silhouette") < 0)).alias("misfit"))


def community_sizes(partition: DataFrame, oversized: int = 5000) -> DataFrame:
    """Per quarter: number of communities, least, median, mean, 90th percentile and greatest size, number above a limit."""
    s = partition.groupBy("q_idx", "community_id").agg(F.count(F.lit(1)).alias("size"))
    return s.groupBy("q_idx").agg(
        F.count(F.lit(1)).alias("communities"), F.min("size").alias("size_min"), F.median("size").alias("size_median"), F.avg("size").alias("size_mean"),
        F.percentile("size", F.lit(0.9)).alias("size_p90"), F.max("size").alias("size_max"), F.count_if(F.col("size") > oversized).alias("oversized"),
    )


def resolution_sweep(quarterly: DataFrame, resolutions: list[float], **options) -> DataFrame:
    """Sizes for each resolution; the driver only lists the settings."""
    out = None
    for r in resolutions:
        one = community_sizes(detect_communities(quarterly, r, **options)).withColumn("resolution", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def lifespans(series: DataFrame) -> DataFrame:
    """(lineage_id, lifespan): distinct quarters of each lineage."""
    return series.groupBy("lineage_id").agg(F.countDistinct("q_idx").alias("lifespan"))


def stable_lineages(series: DataFrame, least: int = 8, most: int | None = None) -> DataFrame:
    """The rows of lineages that live `least` quarters or more (and `most` at most)."""
    kept = lifespans(series).where(F.col("lifespan") >= least)
    kept = kept.where(F.col("lifespan") <= most) if most else kept
    return series.join(kept.select("lineage_id"), "lineage_id", "left_semi")


def stability_report(series: DataFrame, edges: tuple[int, ...] = (1, 2, 4, 8, 12, 20, 40)) -> DataFrame:
    """One row: lineages, mean, median, deviation (population), quantiles and a histogram of lifespans."""
    s = lifespans(series)
    n = F.col("lifespan")
    bounds = [*zip(edges, [*edges[1:], None], strict=True)]
    bins = [F.count_if((n >= lo) & ((n < hi) if hi else F.lit(True))).alias(f"from_{lo}") for lo, hi in bounds]
    return s.agg(F.count(F.lit(1)).alias("lineages"), F.avg(n).alias("mean"), F.median(n).cast("long").alias("median"), F.stddev_pop(n).alias("std"), F.percentile(n, F.lit(0.25)).alias("p25"), F.percentile(n, F.lit(0.75)).alias("p75"), F.max(n).alias("longest"), *bins)


def lineage_papers(registry: DataFrame, partition: DataFrame) -> DataFrame:
    """(lineage_id, work_id, first_q) of all works that a lineage's communities ever held."""
    return registry.join(partition.select("q_idx", "community_id", "work_id"), ["q_idx", "community_id"]).groupBy("lineage_id", "work_id").agg(F.min("q_idx").alias("first_q"))


def stratify(series: DataFrame, brackets: tuple[int, ...] = (1, 2, 4, 8, 16, 32)) -> DataFrame:
    """Lineages by lifespan bracket: number, share and survivors (lineages that live so long or longer)."""
    bracket = F.array_max(F.filter(F.array(*[F.lit(b) for b in brackets]), lambda b: b <= F.col("lifespan")))
    counts = lifespans(series).groupBy(bracket.alias("bracket")).agg(F.count(F.lit(1)).alias("lineages"))
    w = Window.orderBy(F.desc("bracket")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each bracket
    total = F.sum("lineages").over(Window.partitionBy())
    return counts.select("bracket", "lineages", (F.col("lineages") / total).alias("share"), F.sum("lineages").over(w).alias("survivors"))


def greedy_tight_matches(similarity: DataFrame, per_event: int = 3) -> DataFrame:
    """(event_id, lineage_id, similarity, rank): best pairs first, each lineage once and per_event for each event at most.

    At most per_event lineages for each event are ever taken, so an event never needs more than that many times the number of
    events of its own best lineages: only these come to the driver, where the sequential choice runs.
    """
    spark = similarity.sparkSession
    events = similarity.select("event_id").distinct().count()
    best = Window.partitionBy("event_id").orderBy(F.desc("similarity"), "lineage_id")
    candidates = similarity.withColumn("place_", F.row_number().over(best)).where(F.col("place_") <= per_event * events)
    taken: set = set()
    count: dict = defaultdict(int)
    rows = []
    for r in candidates.orderBy(F.desc("similarity"), "event_id", "lineage_id").collect():
        if r["lineage_id"] not in taken and count[r["event_id"]] < per_event:
            taken.add(r["lineage_id"])
            count[r["event_id"]] += 1
            rows.append((r["event_id"], r["lineage_id"], float(r["similarity"]), count[r["event_id"]]))
    kinds = {f.name: f.dataType.simpleString() for f in similarity.schema}
    return spark.createDataFrame(rows, f"event_id {kinds['event_id']}, lineage_id {kinds['lineage_id']}, similarity double, rank int")


def scoped_partition(partition: DataFrame, period: str) -> DataFrame:
    """A partition of delta or annual graphs with q_idx replaced by the place of its period among those that have a graph.

    Core overlaps, matches and lineages then compare each period with the one before that exists, not with the calendar's.
    """
    w = Window.orderBy(period)  # one row for each period
    places = partition.select(period).distinct().withColumn("place_", F.row_number().over(w) - 1)
    return partition.join(F.broadcast(places), period).withColumn("q_idx", F.col("place_").cast("int")).drop("place_")  # few by nature


def activity(partition: DataFrame, registry: DataFrame) -> DataFrame:
    """By lineage: quarters from first to last, those in which it is active, and the share."""
    named = registry.join(partition.select("q_idx", "community_id").distinct(), ["q_idx", "community_id"]).groupBy("lineage_id")
    spans = named.agg((F.max("q_idx") - F.min("q_idx") + 1).alias("span"), F.countDistinct("q_idx").alias("active"))
    return spans.withColumn("share", F.col("active") / F.col("span"))


def trend_by_thirds(rows: DataFrame, value: str, order: str = "q_idx") -> DataFrame:
    """One row: mean value of the first, second and last third of the quarters, and whether it falls, rises or stays (within 5 %)."""
    placed = rows.withColumns({"i_": F.row_number().over(Window.orderBy(order)) - 1, "n_": F.count(F.lit(1)).over(Window.partitionBy())})  # one row for each quarter
    third = F.floor(F.col("i_") * 3 / F.col("n_"))
    means = placed.agg(*[F.avg(F.when(third == i, F.col(value))).alias(name) for i, name in enumerate(("early", "middle", "late"))])
    trend = F.when(F.col("late") < 0.95 * F.col("early"), "falling").when(F.col("late") > 1.05 * F.col("early"), "rising").otherwise("stable")
    return means.withColumn("trend", trend)
