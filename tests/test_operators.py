"""Literal cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quarters as Q
from tidemark.operators import communities, convergence, corpus, detectors, evaluation, kernels, metrics, partitions, series, signals
from tidemark.operators.corpus import RAW_WORK


def line(spark, values, start="2015Q1", key=1):
    q = Q.index_of(start)
    return spark.createDataFrame([(key, q + i, v) for i, v in enumerate(values)], "lineage_id int, q_idx int, new_works long")


def test_quarters(spark):
    rows = spark.createDataFrame([("2020Q3",), ("2020-Q3",), ("Q3 2020",), ("2020-07-15",), ("soon",)], "t string").select(Q.parse_period(F.col("t")).alias("q")).collect()
    assert [r.q for r in rows] == [Q.index_of("2020Q3")] * 4 + [None]
    assert Q.label_of(Q.index_of("1999Q4")) == "1999Q4"
    got = spark.range(1).select(Q.quarter_label(F.lit(Q.index_of("2020Q3"))).alias("l"), Q.quarter_end(F.lit(Q.index_of("2020Q1"))).alias("e")).first()
    assert got.l == "2020Q3" and str(got.e) == "2020-03-31"


def test_flatten(spark):
    raw = '{"id": "https://x/W1", "display_name": "T", "publication_year": 2020, "authorships": [{"author": {"id": "u/A1"}, "institutions": [{"id": "u/I1", "country_code": "DE"}, {"id": "u/I2", "country_code": "FR"}]}], "topics": [{"id": "u/T1", "score": 0.4}, {"id": "u/T2", "score": 0.9}], "referenced_works": ["u/W9"], "abstract_inverted_index": {"a": [0, 3], "b": [1]}}'
    df = spark.createDataFrame([(raw,)], "j string").select(F.from_json("j", RAW_WORK).alias("w")).select("w.*")
    r = corpus.flatten_works(df).first()
    assert (r.work_id, str(r.publication_date), r.first_author_id, r.primary_topic_id, r.referenced_works, r.is_international_collab, r.abstract) == ("W1", "2020-01-01", "A1", "T2", ["W9"], True, "a b  a")


def test_schema_raises_on_null(spark):
    df = spark.createDataFrame([(None,)], "id string")
    with pytest.raises(Exception, match="null in id"):
        corpus.enforce_schema(df, {"id": "string"}, ["id"]).collect()


def test_append_keeps_stored(spark):
    old = spark.createDataFrame([(1, "2020-01-01", "old")], "id int, day string, v string")
    new = spark.createDataFrame([(1, "2020-02-01", "new"), (2, "2020-03-01", "new")], "id int, day string, v string")
    both, mark = corpus.append_new(old, new, "id", "day")
    assert sorted((r.id, r.v) for r in both.collect()) == [(1, "old"), (2, "new")] and mark.first().watermark == "2020-03-01"


def test_core_matching():
    assert partitions.best_assignment(np.array([[2.0, 0.0], [0.0, 2.0]])) == [(0, 0), (1, 1)]
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(30):
        w = rng.integers(0, 9, (rng.integers(1, 5), rng.integers(1, 5))).astype(float)
        n = max(w.shape)
        full = np.zeros((n, n))
        full[: w.shape[0], : w.shape[1]] = w
        best = max(sum(full[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert math.isclose(sum(w[i, j] for i, j in partitions.best_assignment(w)), best)


def test_communities_of_two_cliques():
    pairs = [(i, j) for block in (range(5), range(5, 10)) for i in block for j in block if i < j] + [(0, 5)]
    a, b = np.array(pairs).T
    near = partitions.symmetric(a, b, np.ones(len(a)), 10)
    for label in (partitions.potts_communities(near, 0.3), partitions.consensus_communities(near, 0.3, runs=4)):
        assert len(set(label[:5])) == 1 and len(set(label[5:])) == 1 and label[0] != label[5]
    rank = partitions.pagerank(a, b, 10)
    assert math.isclose(rank.sum(), 1, rel_tol=1e-6)


def test_variation_of_information(spark):
    mk = lambda d: spark.createDataFrame([(1, k, v) for k, v in d.items()], "g int, work_id string, community_id int")
    vi = lambda x, y: communities.variation_of_information(mk(x), mk(y), ["g"]).first().vi
    base = {"A": 1, "B": 1, "C": 2, "D": 2}
    assert vi(base, {"A": 10, "B": 10, "C": 20, "D": 20}) == 0
    assert math.isclose(vi(base, {"A": 1, "B": 1, "C": 1, "D": 2}), 1.18872, abs_tol=1e-4)


def test_densify(spark):
    rows = [(1, "2020Q1", 2), (1, "2020Q3", 5), (2, "2021Q2", 3), (7, "2022Q1", 1), (7, "2022Q1", 2), (7, "2022Q2", 4)]
    s = spark.createDataFrame([(a, Q.index_of(q), n) for a, q, n in rows], "lineage_id int, q_idx int, new_works long")
    got = {}
    for r in series.densify(s, ["lineage_id"]).orderBy("q_idx").collect():
        got.setdefault(r.lineage_id, []).append((r.place, r.new_works))
    assert got == {1: [(0, 2), (1, 0), (2, 5)], 2: [(0, 3)], 7: [(0, 3), (1, 4)]}


@pytest.mark.parametrize(
    ("values", "reason"),
    [([1, 1, 1, 2, 4, 8, 16, 20, 25], "detected"), ([5] * 10, "no_onset"), (list(range(20, 1, -2)), "no_onset"), ([1, 2, 3, 4, 5], "insufficient_history"), ([2, 2, 2, 20, 2, 2, 2, 2], "no_onset")],
)
def test_onset(spark, values, reason):
    r = detectors.onsets(line(spark, values), ["lineage_id"]).first()
    assert r.reason == reason
    if reason == "detected":
        assert r.growth >= 0.1 and r.smoothed >= 3


def test_maturation(spark):
    r = detectors.maturations(line(spark, [1, 5, 20, 40, 20, 5, 1, 0, 0, 0, 0, 0, 0]), ["lineage_id"]).first()
    assert r.kind in ("senescence", "dormancy")
    assert detectors.maturations(line(spark, [1, 5, 20] + [20] * 8), ["lineage_id"]).first().kind == "saturation"


def test_run_length_filter():
    assert len(kernels.run_length_filter(np.array([]))[0]) == 0
    p, _ = kernels.run_length_filter(np.full(20, 10.0))
    assert p[6:].mean() < 0.3
    p, r = kernels.run_length_filter(np.array([5.0] * 15 + [50.0] * 15), 1 / 20, window=3)
    assert p[15:19].max() > p[8:14].max() and r.max() <= 40


def test_tails_and_fits():
    assert math.isclose(kernels.poisson_tail(3, 2.0), 1 - math.exp(-2) * (1 + 2 + 2), rel_tol=1e-9)
    assert 0 < kernels.poisson_tail(60, 2.0) < 1e-40
    assert kernels.negative_binomial_tail(0, 3.0, 2.0) == 1.0
    total = sum(kernels.negative_binomial_tail(n, 3.0, 2.0) - kernels.negative_binomial_tail(n + 1, 3.0, 2.0) for n in range(200))
    assert math.isclose(total, 1, rel_tol=1e-9)
    t = np.arange(30)
    level, rate, middle, r2 = kernels.logistic_fit(100 / (1 + np.exp(-0.5 * (t - 14))))
    assert r2 > 0.999 and abs(middle - 14) < 0.1 and abs(rate - 0.5) < 0.02 and abs(level - 100) < 1
    assert kernels.burst_states(np.array([1, 1, 1, 9, 9, 9, 1, 1])).tolist()[3] > 0
    x = np.concatenate([np.zeros((10, 2)), np.ones((10, 2)) * 5])
    assert kernels.kernel_changepoints(x, 1.0) == [10]


def test_bursts(spark):
    rows = [(f, 7960 + i, 10 + (i % 3)) for f in ("a", "b") for i in range(20)] + [("a", 7980, 60), ("b", 7980, 11)]
    s = spark.createDataFrame(rows, "front string, q_idx int, count long")
    got = {(r.front, r.q_idx): r for r in detectors.burst_alerts(s, ["front"]).collect()}
    assert got["a", 7980].alert and not got["b", 7980].alert and got["a", 7980].q_value <= 0.1


def test_author_migration_and_bridges(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 1, "x"), (2, 1, "y")], "lineage_id int, q_idx int, author_id string")
    assert {r.migration_rate for r in convergence.author_migration(a).collect()} == {1.0}
    refs = spark.createDataFrame([("p1", "p3"), ("p1", "e"), ("p2", "e")], "work_id string, ref_id string")
    of = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 2), ("e", 1)], "work_id string, lineage_id int")
    r = {x.lineage_id: x for x in convergence.citation_bridges(refs, of).collect()}
    assert r[1].bridges == 1


def test_bridging_is_undirected(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert metrics.undirected(e).count() == 1


def test_vote(spark):
    rows = [(1, "f", s, 0.9) for s in (1, 2, 3)] + [(1, "g", s, 0.1) for s in (1, 2, 3)]
    r = signals.vote(spark.createDataFrame(rows, "lineage int, front string, signal int, similarity double")).first()
    assert (r.primary_front, r.confidence, r.alternative_fronts) == ("f", "high", "g")


def test_conformal(spark):
    mk = lambda rows: spark.createDataFrame(rows, "probability double, outcome int")
    assert evaluation.conformal_width(mk([(1.0, 1), (0.0, 0), (1.0, 1), (0.0, 0)])).first().width == 0
    assert evaluation.conformal_width(mk([(0.0, 1), (1.0, 0)])).first().width == 1
    assert evaluation.conformal_width(mk([(0.0, 1)])).first().width == 0.5


def test_ranking_quality(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "probability double, outcome int")
    r = evaluation.ranking_quality(s).first()
    assert math.isclose(r.roc_auc, 0.75) and math.isclose(r.average_precision, (1 + 2 / 3) / 2)
