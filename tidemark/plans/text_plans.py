"""Queries on text and vector signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import text as X
from tidemark.functions.numeric import rounded
from tidemark.operators import convergence, metrics, signals
from tidemark.plans import bindings as B
from tidemark.plans.bindings import TEXTS, VECTORS, with_

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_TERMS = rf"list_filter(regexp_extract_all(lower(COALESCE(text, '')), '([\p{{L}}\p{{N}}_\-]+)'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"
_SET = f"list_distinct({_TERMS})"
TERMS = with_(TEXTS) + f""", tokens AS (SELECT lineage, paper_id, unnest({_TERMS}) AS term FROM texts),
counts AS (SELECT lineage, term, count(*) AS tf FROM tokens GROUP BY ALL)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.term_counts(B.texts(spark, sf_dir))


@query(TERMS + "SELECT * FROM counts")
def d039_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


RANKED = TERMS + """, nk AS (SELECT count(DISTINCT lineage) AS n FROM counts), df AS (SELECT term, count(DISTINCT lineage) AS df FROM counts GROUP BY 1),
sc AS (SELECT lineage, term, tf, df, tf * ln(n / df::DOUBLE) AS score FROM counts JOIN df USING (term), nk),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY score DESC, term)::INTEGER AS rank FROM sc) WHERE rank <= 100)"""


@query(RANKED + "SELECT lineage, term, tf, df, round(score, 6) AS score, rank FROM ranked")
def d040_class_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.class_tfidf(_counts(spark, sf_dir)).withColumn("score", F.round("score", 6))


VOCABULARY = f"vocabulary AS (SELECT DISTINCT 'bench' || (item_id % 3) AS front, unnest({_TERMS}) AS term FROM benchmark)"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the benchmark items as vocabularies of three named fronts."""
    b = B.table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("bench"), (F.col("item_id") % 3).cast("string")).alias("front"), F.explode(X.terms(F.col("text"))).alias("term")).distinct()


@query(RANKED + ", " + VOCABULARY + """, total AS (SELECT lineage, sum(score) AS total FROM ranked WHERE rank <= 50 GROUP BY 1),
hits AS (SELECT lineage, front, sum(score) AS held FROM ranked JOIN vocabulary USING (term) WHERE rank <= 50 GROUP BY ALL)
SELECT t.lineage, f.front, round(CASE WHEN COALESCE(held, 0) / total < 0.0001 THEN 0 ELSE COALESCE(held, 0) / total END, 6) AS similarity
FROM total t CROSS JOIN (SELECT DISTINCT front FROM vocabulary) f LEFT JOIN hits h ON h.lineage = t.lineage AND h.front = f.front""")
def d041_term_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.vocabulary_similarity(signals.class_tfidf(_counts(spark, sf_dir)), _vocabulary(spark, sf_dir), floor=0.0001)
    return s.withColumn("similarity", F.round("similarity", 6))


NPMI = RANKED + f""", held AS (SELECT lineage, paper_id, unnest({_SET}) AS term FROM texts), pk AS (SELECT count(DISTINCT lineage) AS n FROM ranked),
rare AS (SELECT term FROM (SELECT term, count(DISTINCT lineage) AS df FROM held GROUP BY 1), pk WHERE df <= 0.5 * n),
kept AS (SELECT h.* FROM held h WHERE EXISTS (SELECT 1 FROM ranked r WHERE r.lineage = h.lineage AND r.term = h.term) AND term IN (SELECT term FROM rare)),
np AS (SELECT lineage, count(DISTINCT paper_id)::DOUBLE AS n FROM texts GROUP BY 1), c AS (SELECT lineage, term, count(*) AS c FROM kept GROUP BY ALL),
pr AS (SELECT a.lineage, a.term AS x, b.term AS y, count(*) AS pair_n FROM kept a JOIN kept b ON a.lineage = b.lineage AND a.paper_id = b.paper_id AND a.term < b.term GROUP BY ALL HAVING count(*) >= 3),
st AS (SELECT pr.*, n, pair_n / n AS pxy, cx.c / n AS px, cy.c / n AS py, cx.c AS cx, cy.c AS cy FROM pr JOIN np USING (lineage) JOIN c cx ON cx.lineage = pr.lineage AND cx.term = x JOIN c cy ON cy.lineage = pr.lineage AND cy.term = y),
sc2 AS (SELECT lineage, x, y, pair_n AS together, CASE WHEN pxy >= 1 THEN 1 ELSE greatest(-1, least(1, ln(pxy / (px * py)) / -ln(pxy))) END AS npmi,
  2 * (pair_n * ln(pair_n / (n * px * py)) + CASE WHEN cx > pair_n AND py < 1 THEN (cx - pair_n) * ln((cx - pair_n) / (n * px * (1 - py))) ELSE 0 END
   + CASE WHEN cy > pair_n AND px < 1 THEN (cy - pair_n) * ln((cy - pair_n) / (n * (1 - px) * py)) ELSE 0 END
   + CASE WHEN n - cx - cy + pair_n > 0 AND px < 1 AND py < 1 THEN (n - cx - cy + pair_n) * ln((n - cx - cy + pair_n) / (n * (1 - px) * (1 - py))) ELSE 0 END) AS g2 FROM st),
pairs AS (SELECT * FROM sc2 WHERE npmi >= 0.2 AND g2 >= 10.83)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.npmi_pairs(B.texts(spark, sf_dir), signals.class_tfidf(_counts(spark, sf_dir)))


@query(NPMI + "SELECT lineage, x, y, together, round(npmi, 5) AS npmi, round(g2, 4) AS g2 FROM pairs")
def d042_npmi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("lineage", "x", "y", "together", F.round("npmi", 5).alias("npmi"), F.round("g2", 4).alias("g2"))


@query(NPMI + """, rp AS (SELECT lineage, x, y, round(npmi, 9) AS npmi FROM pairs), cut AS (SELECT lineage, quantile_cont(npmi, 0.9) AS cut FROM rp GROUP BY 1)
SELECT lineage, x, y, round(npmi, 5) AS npmi, row_number() OVER (PARTITION BY lineage ORDER BY npmi DESC, x, y)::INTEGER AS rank FROM rp JOIN cut USING (lineage) WHERE npmi >= cut""")
def d043_top_npmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("lineage", "x", "y", F.round("npmi", 9).alias("npmi"))
    return signals.top_share(p).withColumn("npmi", F.round("npmi", 5))


@query(NPMI + ", " + VOCABULARY.replace("item_id % 3", "item_id % 1") + """
SELECT lineage, v.front, round(avg(npmi), 5) AS similarity FROM pairs p JOIN vocabulary v ON p.x = v.term JOIN vocabulary u ON p.y = u.term AND u.front = v.front GROUP BY ALL""")
def d044_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocabulary(spark, sf_dir).withColumn("front", F.lit("bench0")).distinct()
    return signals.pair_similarity(_pairs(spark, sf_dir), v).withColumn("similarity", F.round("similarity", 5))


UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
MEANS = with_(VECTORS) + """, placed AS (SELECT label, v, 0.5 + 0.5 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / count(*) OVER (PARTITION BY label)::DOUBLE AS w FROM vectors),
cells AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x, w FROM placed), sums AS (SELECT label, i, sum(x * w) / sum(w) AS m FROM cells GROUP BY ALL),
packed AS (SELECT label, list(m ORDER BY i) AS m FROM sums GROUP BY 1), means AS (SELECT label, """ + UNIT.format(v="m") + " AS v FROM packed)"


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.vectors(spark, sf_dir).withColumn("w", signals.position_weight(["vec_id"], ["label"]))
    return signals.weighted_mean_vector(v, ["label"], weight=F.col("w"))


@query(MEANS + "SELECT label, unnest(list_transform(v, lambda x: round(x, 6))) AS x, generate_subscripts(v, 1)::INTEGER - 1 AS i FROM means")
def d046_lineage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(MEANS + """, fronts AS (SELECT label % 3 AS front, v FROM means), fm AS (SELECT front, list(m ORDER BY i) AS m FROM (SELECT front, i, avg(x) AS m FROM (SELECT front, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM fronts) GROUP BY ALL) GROUP BY 1),
fv AS (SELECT front, """ + UNIT.format(v="m") + """ AS v FROM fm), al AS (SELECT v FROM means UNION ALL SELECT v FROM fv),
g AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(x) AS m FROM (SELECT generate_subscripts(v, 1) AS i, unnest(v) AS x FROM al) GROUP BY 1)),
ca AS (SELECT label, list_transform(list_zip(v, mean), lambda p: p[1] - p[2]) AS d FROM means, g), cb AS (SELECT front, list_transform(list_zip(v, mean), lambda p: p[1] - p[2]) AS d FROM fv, g)
SELECT label, front, round(list_sum(list_transform(list_zip(ca.d, cb.d), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(ca.d, lambda x: x * x))) / sqrt(list_sum(list_transform(cb.d, lambda x: x * x))), 6) AS similarity FROM ca, cb""")
def d047_centred_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _means(spark, sf_dir)
    fronts = signals.weighted_mean_vector(means.withColumn("front", F.col("label") % 3), ["front"])
    return signals.centred_similarity(means, fronts, "label", "front").withColumn("similarity", F.round("similarity", 6))


@query(with_(TEXTS) + """, k AS (SELECT lineage, paper_id, text, row_number() OVER (PARTITION BY lineage ORDER BY paper_id) AS n FROM texts)
SELECT lineage, count(*) AS papers, md5(substr(string_agg(text, ' ' ORDER BY n), 1, 4000)) AS text_md5 FROM k WHERE n <= 5 GROUP BY 1""")
def d048_quarterly_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = signals.quarterly_texts(B.texts(spark, sf_dir), ["lineage"], "paper_id", most=5)
    return t.select("lineage", "papers", F.md5("text").alias("text_md5"))


@query()
def d048_quarterly_texts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By lineage and quarter, with the operator's own most; d048_quarterly_texts and its SQL twin take five papers of a lineage."""
    t = B.texts(spark, sf_dir).withColumn("q_idx", (F.col("paper_id") % 8).cast("int"))
    return signals.quarterly_texts(t, ["lineage", "q_idx"], "paper_id").select("lineage", "q_idx", "papers", F.md5("text").alias("text_md5"))


@query(with_(VECTORS) + ", u AS (SELECT vec_id, label, " + UNIT.format(v="v") + """ AS v FROM vectors), l AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM u)
SELECT label, vec_id, round(CASE WHEN p IS NULL THEN 0 ELSE 1 - list_sum(list_transform(list_zip(v, p), lambda z: z[1] * z[2])) END, 6) AS velocity FROM l""")
def d049_semantic_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.vector_velocity(B.vectors(spark, sf_dir), ["label"], "vec_id").withColumn("velocity", F.round("velocity", 6))


SIGNALS = """signals AS (SELECT s_suppkey AS lineage, 'F' || f AS front, k AS signal, ((s_suppkey * 7 + f * 13 + k * 5) % 23) / 23.0::DOUBLE AS similarity FROM supplier, range(5) a(f), range(1, 4) b(k))"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic signals of five fronts for each supplier."""
    s = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lineage"))
    grid = s.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("signal", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return grid.select("lineage", F.concat(F.lit("F"), F.col("f").cast("string")).alias("front"), "signal", ((F.col("lineage") * 7 + F.col("f") * 13 + F.col("signal") * 5) % 23 / F.lit(23.0)).alias("similarity"))


VOTE = with_(SIGNALS) + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineage, signal ORDER BY similarity DESC, front) AS place FROM signals WHERE similarity > 0) WHERE place <= 3),
s AS (SELECT lineage, front, sum(similarity * [1.1, 0.5, 1.4][signal]::DOUBLE) AS score, count(*) FILTER (place = 1) AS firsts FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY round(score, 9) DESC, front) AS place FROM s),
g AS (SELECT lineage, max(firsts) AS agree, max(front) FILTER (place = 1) AS primary_front, max(score) FILTER (place = 1) AS score, COALESCE(string_agg(front, '|' ORDER BY place) FILTER (place BETWEEN 2 AND 3), '') AS alternative_fronts FROM r GROUP BY 1),
w AS (SELECT lineage, min(similarity) AS weakest FROM b WHERE place = 1 GROUP BY 1),
v AS (SELECT *, CASE WHEN agree >= 3 AND weakest >= 0.05 THEN 'high' WHEN agree >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM g JOIN w USING (lineage))"""


@query(VOTE + "SELECT lineage, primary_front, alternative_fronts, round(score, 6) AS score, confidence, confidence <> 'high' AS review_needed FROM v")
def d050_front_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.vote(_signals(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(RANKED + ", " + VOCABULARY + """, h AS (SELECT lineage, front, term, rank, row_number() OVER (PARTITION BY lineage, front ORDER BY rank) AS n FROM ranked JOIN vocabulary USING (term))
SELECT lineage, front, string_agg(term, '|' ORDER BY n) AS matched FROM h WHERE n <= 10 GROUP BY ALL""")
def d051_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.evidence(signals.class_tfidf(_counts(spark, sf_dir)), _vocabulary(spark, sf_dir))


@query(VOTE + "SELECT lineage, primary_front FROM v WHERE confidence IN ('high', 'medium')")
def d052_curated_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.curated(signals.vote(_signals(spark, sf_dir))).select("lineage", "primary_front")


@query(with_(SIGNALS) + """, p AS (SELECT *, row_number() OVER (PARTITION BY lineage, signal ORDER BY similarity DESC, front) AS place, similarity / sum(similarity) OVER (PARTITION BY lineage, signal) AS p FROM signals WHERE similarity > 0),
k AS (SELECT lineage, signal, max(similarity) - COALESCE(max(similarity) FILTER (place = 2), 0) AS margin, -sum(p * ln(p)) AS entropy FROM p GROUP BY ALL)
SELECT signal::INTEGER AS signal, count(*) AS keys, round(avg(margin), 6) AS mean_margin, round(avg(entropy), 6) AS mean_entropy FROM k GROUP BY 1""")
def d053_signal_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signal_margins(_signals(spark, sf_dir)).select("signal", "keys", *rounded(["mean_margin", "mean_entropy"]))


@query(with_(SIGNALS) + "SELECT front, signal::INTEGER AS signal, t::DOUBLE AS threshold, count(*) FILTER (similarity >= t) AS matches FROM signals, (SELECT unnest([0.2, 0.5, 0.8]) AS t) GROUP BY ALL")
def d129_match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.match_coverage(_signals(spark, sf_dir), [0.2, 0.5, 0.8])


@query(with_(TEXTS) + f""", tk AS (SELECT DISTINCT lineage, (paper_id % 8)::INTEGER AS q_idx, unnest({_SET}) AS term FROM texts), f AS (SELECT *, min(q_idx) OVER (PARTITION BY lineage, term) = q_idx AS is_new FROM tk),
s AS (SELECT lineage, q_idx, count(*) AS distinct_elements, count(*) FILTER (is_new) AS new_elements FROM f GROUP BY ALL)
SELECT lineage, q_idx, distinct_elements, new_elements, round(new_elements / distinct_elements::DOUBLE, 6) AS novelty_rate, (sum(new_elements) OVER (PARTITION BY lineage ORDER BY q_idx))::BIGINT AS seen_so_far FROM s""")
def d072_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.texts(spark, sf_dir).select("lineage", (F.col("paper_id") % 8).cast("int").alias("q_idx"), F.explode(X.terms(F.col("text"))).alias("term"))
    return metrics.first_seen(t, ["lineage"], "term").withColumn("novelty_rate", F.round("novelty_rate", 6))


SIMILAR = MEANS + """, pr AS (SELECT a.label, b.label AS other, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 9) AS similarity FROM means a JOIN means b ON a.label <> b.label),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, other)::INTEGER AS rank FROM pr) WHERE rank <= 5)"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.similar_lineages(_means(spark, sf_dir), "label", k=5)


@query(SIMILAR + "SELECT label, other, round(similarity, 6) AS similarity, rank FROM near")
def d078_similar_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(SIMILAR + f""", ts AS (SELECT doc_id % 10 AS label, list_distinct(flatten(list({_SET}))) AS terms FROM documents WHERE doc_id % 10 <> 3 GROUP BY 1),
j AS (SELECT n.label, COALESCE(len(list_intersect(a.terms, b.terms)) / nullif(len(list_distinct(list_concat(a.terms, b.terms))), 0)::DOUBLE, 0) AS j FROM near n LEFT JOIN ts a ON n.label = a.label LEFT JOIN ts b ON n.other = b.label)
SELECT label, round(avg(j), 6) AS term_overlap FROM j GROUP BY 1""")
def d081_term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).cast("int").alias("label"), F.explode(X.terms(F.col("text"))).alias("term")).where("label <> 3")
    sets = d.groupBy("label").agg(F.collect_set("term").alias("terms"))
    return convergence.term_overlap(_similar(spark, sf_dir), sets, "label").withColumn("term_overlap", F.round("term_overlap", 6))
