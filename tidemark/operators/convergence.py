"""Convergence of lineages and the disruption index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import dot, ratio, trailing, unit


def similar_lineages(vectors: DataFrame, key: str = "lineage_id", by: str | None = None, k: int = 20, tile: int = 512) -> DataFrame:
    """The k most similar others of each key by cosine, within a quarter if `by` names it; ties by id.

    Keys lie in tiles of about `tile` rows, and every pair of tiles of a quarter is a group of its own, so the comparisons of one
    quarter run in as many tasks as they need; each group returns its k best, which a window merges.
    """
    on = [by] if by else []
    u = vectors.select(*on, key, unit(F.col("v")).alias("u"))
    tiles = u.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))  # one row for each quarter
    placed = (u.join(tiles, on) if on else u.crossJoin(F.broadcast(tiles))).withColumn("tile", F.pmod(F.xxhash64(key), "tiles"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    mine = placed.select(*on, "tile", every.alias("other_tile"), key, "u")
    others = placed.select(*[F.col(c).alias(f"{c}_") for c in on], every.alias("tile_"), F.col("tile").alias("other_tile_"), F.col(key).alias("other"), F.col("u").alias("w"))
    kind = vectors.schema[key].dataType.simpleString()
    groups = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in on)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({**{c: [] for c in on}, key: [], "other": [], "similarity": []})
        left, right = np.stack(a["u"].to_list()), np.stack(b["w"].to_list())
        similarity = np.round(np.einsum("id,jd->ij", left, right), 9)
        names, theirs = a[key].to_numpy(), b["other"].to_numpy()
        order = np.argsort(theirs, kind="stable")
        theirs, similarity = theirs[order], similarity[:, order]
        similarity[names[:, None] == theirs[None, :]] = -np.inf
        top = np.argsort(-similarity, axis=1, kind="stable")[:, :k]  # ties by id
        value = np.take_along_axis(similarity, top, axis=1)
        i, j = np.nonzero(np.isfinite(value))
        return pd.DataFrame({**{c: a[c].iloc[0] for c in on}, key: names[i], "other": theirs[top[i, j]], "similarity": value[i, j]})

    pairs = mine.groupBy(*on, "tile", "other_tile").cogroup(others.groupBy(*[f"{c}_" for c in on], "tile_", "other_tile_"))
    found = pairs.applyInPandas(best, f"{groups + ', ' if groups else ''}{key} {kind}, other {kind}, similarity double")
    keys = [*on, key]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("similarity"), "other"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(*keys, "other", "similarity", "rank")


def author_migration(authorships: DataFrame, key: str = "lineage_id") -> DataFrame:
    """By (key, q_idx): authors, those also active in another key in the quarter, and their share."""
    pairs = authorships.select(key, "q_idx", "author_id").distinct()
    spread = pairs.groupBy("q_idx", "author_id").agg(F.count(F.lit(1)).alias("n"))
    joined = pairs.join(spread, ["q_idx", "author_id"])
    return joined.groupBy(key, "q_idx").agg(F.count(F.lit(1)).alias("authors"), F.count_if(F.col("n") > 1).alias("migrating")).withColumn("migration_rate", ratio(F.col("migrating"), F.col("authors")))


def citation_bridges(refs: DataFrame, lineage_of: DataFrame, key: str = "lineage_id") -> DataFrame:
    """By key: papers and those whose resolved references reach two lineages or more."""
    named = lineage_of.select("work_id", key)
    hits = refs.join(named.select(F.col("work_id").alias("ref_id"), F.col(key).alias("to_")), "ref_id").groupBy("work_id").agg(F.countDistinct("to_").alias("n"))
    joined = named.join(hits, "work_id", "left")
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.coalesce("n", F.lit(0)) >= 2).alias("bridges")).withColumn("bridge_rate", ratio(F.col("bridges"), F.col("papers")))


def term_overlap(neighbours: DataFrame, term_sets: DataFrame, key: str = "lineage_id", k: int = 5) -> DataFrame:
    """Mean Jaccard similarity of a key's term set with those of its k nearest; a missing set counts as 0."""
    a, b = term_sets.select(key, F.col("terms").alias("a")), term_sets.select(F.col(key).alias("other"), F.col("terms").alias("b"))
    joined = neighbours.where(F.col("rank") <= k).join(a, key, "left").join(b, "other", "left")
    j = ratio(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b")))
    return joined.groupBy(key).agg(F.avg(F.coalesce(j, F.lit(0.0))).alias("term_overlap"))


def convergence_composite(features: DataFrame, key: str = "lineage_id") -> DataFrame:
    """Mean of max_sim, migration_rate, bridge_rate and term_overlap, velocity of max_sim, rolling means of active quarters and greatest deviation."""
    w = Window.partitionBy(key).orderBy("q_idx")
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("max_sim", "migration_rate", "bridge_rate", "term_overlap")]
    out = features.withColumn("composite", sum(parts[1:], parts[0]) / 4).withColumn("velocity", F.coalesce(F.col("max_sim") - F.lag("max_sim").over(w), F.lit(0.0)))
    return _rolled(out, key)


def _rolled(out: DataFrame, key: str) -> DataFrame:
    year = trailing([key], "q_idx", 4)
    withs = out.withColumns({"roll_2": F.avg("composite").over(trailing([key], "q_idx", 2)), "roll_4": F.avg("composite").over(year), "held_": F.collect_list("composite").over(year)})
    return withs.select(key, "q_idx", "composite", "velocity", "roll_2", "roll_4", F.expr("array_max(transform(held_, x -> abs(x - roll_4)))").alias("max_dev"))


def cross_lineage_share(refs: DataFrame, lineage_of: DataFrame, key: str = "lineage_id") -> DataFrame:
    """Share of a key's resolved references that go to other keys."""
    named = lineage_of.select("work_id", key)
    joined = refs.join(named, "work_id").join(named.select(F.col("work_id").alias("ref_id"), F.col(key).alias("to_")), "ref_id")
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("resolved"), F.avg((F.col("to_") != F.col(key)).cast("double")).alias("cross_share"))


def disruption(works: DataFrame, refs: DataFrame, focal: DataFrame) -> DataFrame:
    """CD index of the focal works: (n_u - n_v) / (n_u + n_v + n_w) over works of later years.

    n_u cite the focal work but none of its references, n_v both, n_w only references. Citing pairs are distinct and joined on
    works, so the second hop's size is the citers of the references; adaptive execution splits popular ones.
    """
    year = works.select("work_id", "pub_year")
    f = focal.select("work_id").join(year, "work_id").select(F.col("work_id").alias("focal"), F.col("pub_year").alias("focal_year"))
    cites = refs.select("work_id", "ref_id").distinct().join(year, "work_id").select(F.col("work_id").alias("citer"), F.col("ref_id").alias("cited"), F.col("pub_year").alias("citer_year"))
    direct = f.join(cites, F.col("focal") == F.col("cited")).where("citer_year > focal_year").select("focal", "citer").distinct()
    own = f.join(refs.select(F.col("work_id").alias("focal"), F.col("ref_id").alias("cited")).distinct(), "focal")
    through = own.join(cites, "cited").where("citer_year > focal_year AND citer <> focal").select("focal", "citer").distinct()
    both = direct.withColumn("d", F.lit(1)).join(through.withColumn("t", F.lit(1)), ["focal", "citer"], "outer")
    d, t = F.col("d").isNotNull(), F.col("t").isNotNull()
    sums = both.groupBy("focal").agg(F.count_if(d & ~t).alias("n_u"), F.count_if(d & t).alias("n_v"), F.count_if(~d & t).alias("n_w"))
    out = f.select("focal").join(sums, "focal", "left")
    n_u, n_v, n_w = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_u", "n_v", "n_w"))
    out = out.select(F.col("focal").alias("work_id"), n_u, n_v, n_w)
    return out.withColumn("cd_index", ratio(F.col("n_u") - F.col("n_v"), F.col("n_u") + F.col("n_v") + F.col("n_w"), None))


def new_papers(members: DataFrame, key: str = "lineage_id") -> DataFrame:
    """(key, q_idx, new_papers): papers in the first quarter that the key holds them."""
    first = members.groupBy(key, "work_id").agg(F.min("q_idx").alias("q_idx"))
    return first.groupBy(key, "q_idx").agg(F.count(F.lit(1)).alias("new_papers"))
