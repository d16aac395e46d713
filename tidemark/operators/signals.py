"""Text and vector signals that name lineages, and their vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import dot, ratio, unit
from tidemark.functions.text import terms


def term_counts(papers: DataFrame, key: str = "lineage", text: str = "text") -> DataFrame:
    """(key, term, tf) over all papers of a key."""
    return papers.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def class_tfidf(counts: DataFrame, key: str = "lineage", top: int = 100) -> DataFrame:
    """tf * ln(N / df) of each term, N keys in all; the `top` best of each key, ties by term."""
    n = counts.select(key).distinct().agg(F.count(F.lit(1)).alias("n_keys"))
    df = counts.groupBy("term").agg(F.countDistinct(key).alias("df"))
    scored = counts.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", F.col("tf") * F.log(F.col("n_keys") / F.col("df")))  # one row
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", place).where(F.col("rank") <= top).select(key, "term", "tf", "df", "score", "rank")


def vocabulary_similarity(ranked: DataFrame, vocabulary: DataFrame, key: str = "lineage", top: int = 50, floor: float = 0.01) -> DataFrame:
    """(key, front, similarity): the part of a key's top scores whose terms are in the front's vocabulary (front, term); below floor 0."""
    best = ranked.where(F.col("rank") <= top)
    total = best.groupBy(key).agg(F.sum("score").alias("total"))
    hits = best.join(vocabulary.distinct(), "term").groupBy(key, "front").agg(F.sum("score").alias("held"))
    grid = total.crossJoin(F.broadcast(vocabulary.select("front").distinct()))  # a dictionary of named fronts, a handful of rows
    s = ratio(F.coalesce("held", F.lit(0.0)), F.col("total"))
    return grid.join(hits, [key, "front"], "left").select(key, "front", F.when(s < floor, 0.0).otherwise(s).alias("similarity"))


def npmi_pairs(papers: DataFrame, ranked: DataFrame, key: str = "lineage", paper: str = "paper_id", text: str = "text", least: int = 3, least_g2: float = 10.83, least_npmi: float = 0.2, common: float = 0.5) -> DataFrame:
    """Normalised pointwise mutual information of terms in the papers of a key, from the key's own ranked vocabulary.

    Terms that more than `common` of the keys hold go first, then the vocabulary restricts, and only then pairs are made: the
    self-join is by paper, so a pair count grows with the vocabulary of one paper. Keeps pairs in `least` papers or more with
    G-squared and npmi above their floors.
    """
    held = papers.select(key, paper, F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    n_keys = ranked.select(key).distinct().agg(F.count(F.lit(1)).alias("n_keys"))
    rare = held.select(key, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n_keys)).where(F.col("df") <= common * F.col("n_keys")).select("term")  # one row
    kept = held.join(ranked.select(key, "term"), [key, "term"], "left_semi").join(rare, "term", "left_semi")
    n = papers.groupBy(key).agg(F.countDistinct(paper).alias("n"))
    single = kept.groupBy(key, "term").agg(F.count(F.lit(1)).alias("c"))
    pairs = kept.withColumnRenamed("term", "x").join(kept.withColumnRenamed("term", "y"), [key, paper]).where("x < y").groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("together"))
    pairs = pairs.where(F.col("together") >= least).join(single.select(key, F.col("term").alias("x"), F.col("c").alias("cx")), [key, "x"]).join(single.select(key, F.col("term").alias("y"), F.col("c").alias("cy")), [key, "y"]).join(n, key)
    total = F.col("n").cast("double")
    pxy, px, py = F.col("together") / total, F.col("cx") / total, F.col("cy") / total
    npmi = F.when(pxy >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log(pxy / (px * py)) / -F.log(pxy))))
    cells = [(F.col("together"), px * py), (F.col("cx") - F.col("together"), px * (1 - py)), (F.col("cy") - F.col("together"), (1 - px) * py), (total - F.col("cx") - F.col("cy") + F.col("together"), (1 - px) * (1 - py))]
    g2 = 2 * sum((F.when((o > 0) & (p > 0), o * F.log(o / (total * p))).otherwise(0.0) for o, p in cells), F.lit(0.0))
    return pairs.select(key, "x", "y", "together", npmi.alias("npmi"), g2.alias("g2")).where((F.col("npmi") >= least_npmi) & (F.col("g2") >= least_g2))


def top_share(pairs: DataFrame, key: str = "lineage", share: float = 0.9, score: str = "npmi") -> DataFrame:
    """The rows of a key at or above the given quantile of its scores, ranked."""
    cut = pairs.groupBy(key).agg(F.percentile(score, F.lit(share)).alias("cut_"))
    order = Window.partitionBy(key).orderBy(F.desc(score), "x", "y")
    return pairs.join(cut, key).where(F.col(score) >= F.col("cut_")).drop("cut_").withColumn("rank", F.row_number().over(order))


def pair_similarity(pairs: DataFrame, vocabulary: DataFrame, key: str = "lineage") -> DataFrame:
    """(key, front, similarity): mean npmi of the pairs with both terms in the front's vocabulary."""
    v = vocabulary.distinct()
    both = pairs.join(v.select("front", F.col("term").alias("x")), "x").join(v.select("front", F.col("term").alias("y")), ["front", "y"])
    return both.groupBy(key, "front").agg(F.avg("npmi").alias("similarity"))


def weighted_mean_vector(rows: DataFrame, keys: list[str], vector: str = "v", weight: Column | None = None) -> DataFrame:
    """(keys, v): the weighted mean of vectors scaled to length 1, summed component by component across the cluster."""
    w = weight if weight is not None else F.lit(1.0)
    cells = rows.select(*keys, w.alias("w_"), F.posexplode(vector).alias("i", "x"))
    sums = cells.groupBy(*keys, "i").agg(F.sum(F.col("x").cast("double") * F.col("w_")).alias("s"), F.sum("w_").alias("t"))
    packed = sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.try_divide("s", "t").alias("m")))), lambda c: c["m"]).alias("v"))
    return packed.select(*keys, unit(F.col("v")).alias("v"))


def position_weight(order: list[Column | str], keys: list[str]) -> Column:
    """.5 + .5 * i / n by the place i from 0 among n rows of a group."""
    w = Window.partitionBy(*keys)
    return 0.5 + 0.5 * (F.row_number().over(w.orderBy(*order)) - 1) / F.count(F.lit(1)).over(w)


def centred_similarity(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Cosine of (key, v) tables after the mean of all vectors of both is taken away. right is a dictionary of named fronts."""
    both = left.select("v").unionAll(right.select("v"))
    mean = both.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("mean"))
    centred = lambda t, k: t.crossJoin(F.broadcast(mean)).select(k, unit(F.zip_with("v", "mean", lambda a, b: a - b)).alias("v"))  # noqa: E731  one row
    a, b = centred(left, left_key), centred(right, right_key).withColumnRenamed("v", "u")
    return a.crossJoin(F.broadcast(b)).select(left_key, right_key, dot(F.col("v"), F.col("u")).alias("similarity"))  # a handful of fronts


def vector_velocity(vectors: DataFrame, keys: list[str], order: str = "q_idx") -> DataFrame:
    """Cosine distance to the previous available vector of the group; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    u = vectors.withColumn("u", unit(F.col("v")))
    prev = F.lag("u").over(w)
    return u.select(*keys, order, F.coalesce(1 - dot(F.col("u"), prev), F.lit(0.0)).alias("velocity"))


def quarterly_texts(papers: DataFrame, keys: list[str], order: str, text: str = "text", most: int = 50, chars: int = 4000) -> DataFrame:
    """Texts of the first `most` papers of a group, joined by spaces and cut at `chars` characters: what an embedding model is fed."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    kept = papers.withColumn("place_", place).where(F.col("place_") <= most)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place_", text))), lambda s: s[text]), " ")
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("papers"), F.substr(joined, F.lit(1), F.lit(chars)).alias("text"))


def vote(signals: DataFrame, key: str = "lineage", weights: tuple[float, float, float] = (1.1, 0.5, 1.4), floor: float = 0.05) -> DataFrame:
    """The front of each key by three signals (key, front, signal 1 to 3, similarity): weighted sum over each signal's three best.

    confidence: high if all three signals agree on their best, medium if two, else low; a high one with a best score under
    floor is medium. Ties by front name. review_needed unless high.
    """
    place = F.row_number().over(Window.partitionBy(key, "signal").orderBy(F.desc("similarity"), "front"))
    best = signals.where("similarity > 0").withColumn("place", place).where("place <= 3")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("signal"))
    sums = best.groupBy(key, "front").agg(F.sum(F.col("similarity") * w).alias("score"), F.count_if(F.col("place") == 1).alias("firsts"))
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "front"))
    ranked = sums.withColumn("place", order)
    agree = ranked.groupBy(key).agg(F.max("firsts").alias("agree"), F.max(F.when(F.col("place") == 1, F.col("front"))).alias("primary_front"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("score"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place").between(2, 3), F.struct("place", "front")))), lambda s: s["front"]), "|").alias("alternative_fronts"))
    weakest = best.where("place = 1").groupBy(key).agg(F.min("similarity").alias("weakest"))
    confidence = F.when((F.col("agree") >= 3) & (F.col("weakest") >= floor), "high").when(F.col("agree") >= 2, "medium").otherwise("low")
    return agree.join(weakest, key).select(key, "primary_front", "alternative_fronts", "score", confidence.alias("confidence"), (confidence != "high").alias("review_needed"))


def evidence(ranked: DataFrame, vocabulary: DataFrame, key: str = "lineage", k: int = 10) -> DataFrame:
    """(key, front, matched): the k best-ranked terms of a key that are in the front's vocabulary."""
    hits = ranked.join(vocabulary.distinct(), "term")
    place = F.row_number().over(Window.partitionBy(key, "front").orderBy("rank"))
    return hits.withColumn("place_", place).where(F.col("place_") <= k).groupBy(key, "front").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place_", "term"))), lambda s: s["term"]), "|").alias("matched"))


def curated(mapping: DataFrame) -> DataFrame:
    """Mappings of medium confidence or more."""
    return mapping.where(F.col("confidence").isin("high", "medium"))


def signal_margins(signals: DataFrame, key: str = "lineage") -> DataFrame:
    """By signal: mean lead of the best front over the second and mean entropy of a key's scores: the base of signal weights."""
    place = F.row_number().over(Window.partitionBy(key, "signal").orderBy(F.desc("similarity"), "front"))
    total = F.sum("similarity").over(Window.partitionBy(key, "signal"))
    p = signals.where("similarity > 0").withColumns({"place": place, "p": F.col("similarity") / total})
    per_key = p.groupBy(key, "signal").agg((F.max("similarity") - F.coalesce(F.max(F.when(F.col("place") == 2, F.col("similarity"))), F.lit(0.0))).alias("margin"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))
    return per_key.groupBy("signal").agg(F.count(F.lit(1)).alias("keys"), F.avg("margin").alias("mean_margin"), F.avg("entropy").alias("mean_entropy"))


def match_coverage(signals: DataFrame, thresholds: list[float], key: str = "lineage") -> DataFrame:
    """Keys that reach each threshold, by front and signal."""
    at = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    return signals.withColumn("threshold", at).groupBy("front", "signal", "threshold").agg(F.count_if(F.col("similarity") >= F.col("threshold")).alias("matches"))


def stage_weights(signals: DataFrame, key: str = "lineage") -> DataFrame:
    """By signal: mean margin and entropy, how often it is the odd one out of three, and the weight these suggest (weights sum to 3).

    A weight adds up, each relative to the best signal: margin times share of clear winners (.35), decisiveness 1 / (entropy + .1)
    (.25), agreement (.20) and spread of the best scores (.20). Entropy is of a key's scores brought to [0, 1].
    """
    w = Window.partitionBy(key, "signal")
    placed = signals.withColumns({"place": F.row_number().over(w.orderBy(F.desc("similarity"), "front")), "low": F.min("similarity").over(w), "high": F.max("similarity").over(w)})
    scaled = placed.withColumn("s", ratio(F.col("similarity") - F.col("low"), F.col("high") - F.col("low")))
    shares = scaled.withColumn("p", ratio(F.col("s"), F.sum("s").over(w)))
    at = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    entropy = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))
    best = shares.groupBy(key, "signal").agg(F.max("similarity").alias("top"), (F.max("similarity") - at(2, "similarity")).alias("margin"), entropy.alias("entropy"), at(1, "front").alias("best"))
    # Odd: the two other signals of a key agree on another front.
    choices = Window.partitionBy(key)
    same = F.count(F.lit(1)).over(Window.partitionBy(key, "best"))
    judged = best.withColumns({"same": same, "most": F.lit(0)}).withColumn("most", F.max("same").over(choices))
    odd = (F.col("same") == 1) & (F.col("most") == 2)
    by = judged.groupBy("signal").agg(
        F.avg("margin").alias("mean_margin"), F.avg((F.col("margin") > 0.1).cast("double")).alias("clear"), F.avg("entropy").alias("mean_entropy"), F.count_if(odd).alias("odd_one_out"), F.stddev_pop("top").alias("spread"),
    )
    every = Window.partitionBy()  # one row for each signal
    relative = lambda c: ratio(c, F.max(c).over(every))
    agreement = F.when(F.sum("odd_one_out").over(every) > 0, 1 - ratio(F.col("odd_one_out"), F.sum("odd_one_out").over(every))).otherwise(1.0)
    worth = 0.35 * relative(F.col("mean_margin") * F.col("clear")) + 0.25 * relative(1 / (F.col("mean_entropy") + 0.1)) + 0.2 * agreement + 0.2 * relative(F.col("spread"))
    raw = by.withColumn("raw", worth)
    return raw.select("signal", "mean_margin", "mean_entropy", "odd_one_out", (3 * ratio(F.col("raw"), F.sum("raw").over(every))).alias("weight"))
