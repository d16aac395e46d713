"""Literal and brute-force cases of features, checks, relations, matching, tails, streams and sources."""

import itertools
import json
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.functions import text as X
from tidemark.operators import checks, communities, convergence, corpus, evaluation, features, graph, kernels, partitions, relations, signals
from tidemark.sources import files, readers, sinks
from tidemark.streaming import events as S


def test_tails_against_sums():
    for x, mean in ((1, 0.3), (5, 2.0), (12, 30.0), (40, 30.0), (300, 250.0)):
        below = sum(math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(x))
        assert math.isclose(kernels.poisson_tail(x, mean), 1 - below, rel_tol=1e-9, abs_tol=1e-12)
        for k in (0.4, 3.0, 50.0):
            p = k / (k + mean)
            below = sum(math.exp(math.lgamma(n + k) - math.lgamma(k) - math.lgamma(n + 1) + k * math.log(p) + n * math.log(1 - p)) for n in range(x))
            assert math.isclose(kernels.negative_binomial_tail(x, mean, k), 1 - below, rel_tol=1e-8, abs_tol=1e-11)
    began = time.time()
    many = kernels.poisson_tail(np.full(1000, 1_000_000), np.linspace(0.99e6, 1.01e6, 1000))
    assert (np.diff(many) >= 0).all() and 0 < many[500] < 1 and time.time() - began < 20
    assert kernels.poisson_tail(np.array([0, 3]), np.array([2.0, 0.0])).tolist() == [1.0, 0.0]


def test_matching_is_the_best_assignment():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = rng.integers(0, 6, (rng.integers(1, 6), rng.integers(1, 6)))
        best = 0
        a, b = (w, w.T)[w.shape[0] > w.shape[1]], None
        for b in itertools.permutations(range(a.shape[1]), a.shape[0]):
            best = max(best, sum(a[i, j] for i, j in enumerate(b)))
        found = partitions.best_assignment(w.astype(float))
        assert sum(w[i, j] for i, j in found) == best and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)


def test_lineages_by_hand(spark):
    part = spark.createDataFrame([(q, w, c) for q, c, ws in [(1, 10, "abc"), (1, 20, "de"), (2, 5, "abcx"), (2, 6, "dey"), (2, 7, "z"), (4, 1, "abc")] for w in ws], "q_idx int, work_id string, community_id long")
    overlaps = communities.core_overlaps(part)
    matches = communities.match_cores(overlaps)
    got = {(r.q_idx, r.community_id): r.lineage_id for r in communities.assign_lineages(part, matches).collect()}
    assert got == {(1, 10): 1, (1, 20): 2, (2, 5): 1, (2, 6): 2, (2, 7): 3, (4, 1): 4}  # a missing quarter breaks lineages
    dense = communities.scoped_partition(part.withColumnRenamed("q_idx", "period"), "period")
    got = communities.assign_lineages(dense, communities.match_cores(communities.core_overlaps(dense)))
    assert {r.lineage_id for r in got.where("q_idx = 2").collect()} == {1}  # of what exists, one follows the other


def test_pagerank_by_powers():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 30, (80, 2)), axis=0)
    n = 30
    m = np.zeros((n, n))
    for a, b in pairs:
        m[b, a] += 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / n) * 0.85 + 0.15 / n
    want = np.linalg.matrix_power(m, 300) @ np.full(n, 1 / n)
    assert np.abs(partitions.pagerank(pairs[:, 0], pairs[:, 1], n, tolerance=1e-12) - want).max() < 1e-8


def test_pagerank_by_joins_is_that_of_one_task(spark):
    rng = random.Random(3)
    edges = sorted({(q, rng.randrange(12), rng.randrange(12)) for q in (1, 2) for _ in range(25)})
    df = spark.createDataFrame(edges, "q_idx int, src long, dst long")
    got = {(r.q_idx, r.work_id): r.rank for r in communities.pagerank_by_joins(df, tolerance=1e-5).collect()}
    for q in (1, 2):
        own = [(a, b) for k, a, b in edges if k == q]
        names = sorted({x for e in own for x in e})
        want = partitions.pagerank(np.array([names.index(a) for a, _ in own]), np.array([names.index(b) for _, b in own]), len(names), tolerance=1e-12)
        assert max(abs(got[q, w] - want[i]) for i, w in enumerate(names)) < 1e-3


def test_greedy_matches_need_no_whole_table(spark):
    rng = random.Random(4)
    rows = [(e, l, rng.random()) for e in range(4) for l in range(60)]
    got = {(r.event_id, r.lineage_id) for r in communities.greedy_tight_matches(spark.createDataFrame(rows, "event_id int, lineage_id int, similarity double"), 2).collect()}
    taken, count, want = set(), Counter(), set()
    for e, l, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if l not in taken and count[e] < 2:
            taken.add(l)
            count[e] += 1
            want.add((e, l))
    assert got == want


def test_label_propagation(spark):
    edges = [(a, b) for c in (range(0, 5), range(10, 15)) for a in c for b in c if a < b] + [(4, 10)]
    got = {r.work_id: r.community_id for r in communities.label_propagation(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1


def test_coupling_blocks_keep_all_pairs(spark):
    rng = random.Random(5)
    refs = {(rng.randrange(60), rng.choice([1, 1, 1, 2, 3, 4, 5])) for _ in range(250)}
    by = defaultdict(set)
    for w, r in refs:
        by[w].add(r)
    want = {(a, b): len(by[a] & by[b]) for a, b in itertools.combinations(sorted(by), 2) if len(by[a] & by[b]) >= 2}
    df = spark.createDataFrame(sorted(refs), "work_id long, ref_id long")
    for block in (7, 1024):
        assert {(r.node_a, r.node_b): r.shared_refs for r in graph.shared_references(df, 2, block).collect()} == want


def test_similar_in_tiles(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 5))
    v[7] = v[3]
    rows = [(i % 2, i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "q_idx int, lineage_id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {i: sorted((j for j in range(40) if j != i and j % 2 == i % 2), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:4] for i in range(40)}
    got = defaultdict(list)
    for r in convergence.similar_lineages(df, by="q_idx", k=4, tile=6).orderBy("lineage_id", "rank").collect():
        got[r.lineage_id].append(r.other)
    assert got == want


def test_abstract_gaps_and_collisions(spark):
    cases = [({"a": [0, 3], "b": [1]}, "a b  a"), ({"x": [2]}, "  x"), ({"a": [0], "c": [0], "b": [1]}, "c b"), ({}, None), (None, None)]
    df = spark.createDataFrame([(m,) for m, _ in cases], "m map<string, array<int>>")
    assert [r.t for r in df.select(corpus.abstract_text(F.col("m")).alias("t")).collect()] == [t for _, t in cases]


def test_terms_of_any_script(spark):
    df = spark.createDataFrame([("Über die STRASSE, наука and 日本語 of h2o-x C6H12O6!",)], "t string")
    assert df.select(X.terms(F.col("t")).alias("w")).first().w == ["über", "die", "strasse", "наука", "日本語", "h2o-x", "c6h12o6"]
    assert df.select(X.terms(F.lit("a ca(oh)2 mix"), formulas=(r"[a-z]+\([a-z]+\)\d",)).alias("w")).first().w == ["ca(oh)2", "mix"]


def test_feature_registry():
    assert len(features.group("core")) == 20 and len(features.group("context")) == 35
    columns = ["cd_index", "new_works", "conv_b", "conv_a", "author_influx_z", "field_total", "growth_vs_field", "lineage_id"]
    assert features.select_features(columns) == ["new_works", "cd_index", "author_influx_z", "conv_a", "conv_b", "growth_vs_field", "field_total"]
    assert features.select_features(columns, leakage_safe=True) == ["new_works", "author_influx_z", "conv_a", "conv_b"]
    assert features.select_features(columns, "only") == ["growth_vs_field", "field_total"]
    assert features.resolve(["growth"], ["x"], ["growth_*"]) == ["new_works", "total_works", "x"]
    with pytest.raises(ValueError, match="field-relative"):
        features.select_features(["new_works"], "only")
    with pytest.raises(KeyError):
        features.group("nothing")


def test_relations(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 9.0), (2, 30.0), (3, None), (4, 40.0)], "a int, b double")
    r = relations.correlations(df, "a", "b").first()
    assert r.n == 4 and math.isclose(r.spearman, np.corrcoef([1, 2.5, 2.5, 4], [2, 1, 3, 4])[0, 1])
    t = {(x.a, x.b): x.n for x in relations.crosstab(df.selectExpr("a", "b > 20 AS b"), "a", "b").collect()}
    assert t["All", "All"] == 5 and t["2", "All"] == 2 and t["3", "null"] == 1
    big = spark.range(5000).selectExpr("id % 2 AS g", "id % 701 AS item", "id AS v")
    s = {x.g: x for x in relations.sketches(big, ["g"], "item", "v").collect()}
    assert all(abs(x.distinct - 701) < 60 and abs(x.median - 2500) < 120 for x in s.values())
    assert relations.columns_like(df.withColumn("ab", F.lit(1)), "a.*") == ["a", "ab"]
    assert relations.unpacked(spark.createDataFrame([("{bad",)], "packed string"), "x int").first().x is None


def test_checks_and_freshness(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (1, -1.0), (None, 2.0)], "id int, v double")
    got = {r.check: (r.failed, r.passed) for r in checks.check_rows(df, {"id": F.col("id").isNotNull(), "v": F.col("v") > 0, "fine": F.lit(True)}).collect()}
    assert got == {"id": (1, False), "v": (1, False), "fine": (0, True)}
    assert checks.check_unique(df, ["id"], "u").first().failed == 1
    assert checks.check_known(df, "id", spark.range(2, 4), "id", "k").first().failed == 2
    assert checks.check_rows(df.where("false"), {"id": F.col("id").isNotNull()}).first().rows == 0
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    df.write.parquet(a)
    time.sleep(1.1)
    df.write.parquet(b)
    assert checks.stale(spark, b, [a]) == [] and checks.stale(spark, a, [b]) == [b]
    with pytest.raises(RuntimeError, match="older"):
        checks.require_fresh(spark, a, [b])
    one, two = checks.provenance(spark, [a], {"x": 1}), checks.provenance(spark, [a], {"x": 1})
    assert one == two and len(one["inputs"][a]) == 64


def test_sinks_and_small_files(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "pub_qtr int, n int")
    sinks.write_slices(df, str(tmp_path / "s"))
    assert {r.pub_qtr: r.rows for r in sinks.slice_stats(spark, str(tmp_path / "s")).collect()} == {0: 10, 1: 10, 2: 10}
    sinks.snapshot(df, str(tmp_path / "snap"), {"why": "test"})
    assert sinks.verify_manifest(str(tmp_path / "snap")) == []
    with pytest.raises(Exception, match="exist"):
        sinks.snapshot(df, str(tmp_path / "snap"), {})
    sinks.write_raw(df, str(tmp_path / "raw"), 7)
    assert readers.read(spark, {"kind": "ndjson", "path": str(tmp_path / "raw"), "schema": "pub_qtr int, n int"}).count() == 30
    sinks.write_graph(df.selectExpr("n AS work_id"), df.selectExpr("n AS src", "n + 1 AS dst", "pub_qtr AS valid_from_q"), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).where("valid_from_q <= 1").count() == 20
    sinks.write_results(df, str(tmp_path / "csv"), "csv", ["n"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 30
    with pytest.raises(ValueError, match="result kind"):
        sinks.write_results(df, str(tmp_path / "x"), "xml")
    files.write_text(spark, str(tmp_path / "t.txt"), "one\ntwo")
    files.write_text(spark, str(tmp_path / "t.txt"), "three\nfour")
    assert files.read_text(spark, str(tmp_path / "t.txt")) == "three\nfour" and files.names(spark, str(tmp_path / "none")) == []
    assert readers.keyed(df, "n", spark.createDataFrame([(3,), (4,), (99,)], "n int")).count() == 2
    (tmp_path / "log.json").write_text("\n".join(json.dumps({"ts": f"2024-01-0{i}T00:00:00Z", "kind": "run" if i % 2 else "load", "status": "ok", "message": str(i)}) for i in range(1, 8)))
    assert [r.message for r in sinks.audit_events(spark, str(tmp_path / "log.json"), kind="run", since="2024-01-03", limit=2).collect()] == ["7", "5"]


def test_cursor_pages(monkeypatch):
    pages = {"*": ([{"id": "a"}, {"id": "b"}], "c1"), "c1": ([{"id": "c"}], "c2"), "c2": ([], "c3")}
    asked = []

    def fetch(url):
        asked.append(url)
        cursor = dict(p.split("=") for p in url.split("?")[1].split("&"))["cursor"]
        works, following = pages["*" if cursor == "%2A" else cursor]
        return {"results": works, "meta": {"next_cursor": following}}

    monkeypatch.setattr(readers, "fetch", fetch)
    reader = readers.WorksReader({"url": "http://x/works", "filter": "a:x|y,b:z z", "sort": "id"})
    assert [w[0] for p in reader.partitions() for w in reader.read(p)] == ["a", "b", "c"] and len(asked) == 3
    assert "filter=a%3Ax%7Cy%2Cb%3Az+z" in asked[0] and "sort=id" in asked[0]
    few = readers.WorksReader({"url": "http://x/works", "max_records": "1"})
    assert [w[0] for w in few.read(few.partitions()[0])] == ["a"]
    assert len(readers.WorksReader({"url": "u", "pages": "4"}).partitions()) == 4


def test_stream_filter_is_the_batch_filter(spark, tmp_path):
    rng = random.Random(7)
    counts = [rng.randint(2, 8) for _ in range(120)] + [rng.randint(30, 50) for _ in range(80)]
    (tmp_path / "in").mkdir()
    for part, own in enumerate((range(70), range(70, 150), range(150, 200))):
        rows = [(1, i, counts[i]) for i in own] + ([(1, 3, 9)] if part == 2 else [])
        spark.createDataFrame(rows, "lineage_id int, q_idx int, new_works long").coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
        next((tmp_path / f"p{part}").glob("part-*")).rename(tmp_path / "in" / f"f{part}.parquet")
        time.sleep(0.02)
    stream = S.stream_files(spark, str(tmp_path / "in"), "lineage_id int, q_idx int, new_works long")
    q = S.changepoints(stream).writeStream.format("memory").queryName("cp200").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM cp200").collect()
    got = {r.q_idx: r.changepoint_prob for r in rows if not r.late}
    want, _ = kernels.run_length_filter(np.array(counts, dtype=float))
    assert sorted(got) == list(range(200)) and max(abs(got[i] - want[i]) for i in got) < 1e-12
    assert [(r.q_idx, r.changepoint_prob) for r in rows if r.late] == [(3, None)]


def test_briefing(spark):
    rows = [(q, k, p) for k, ps in (("a", (0.1, 0.2)), ("b", (0.3, 0.08)), ("c", (0.0, 0.01)), ("d", (0.5,))) for q, p in enumerate(ps)]
    found = evaluation.briefing_rows(spark.createDataFrame(rows, "q_idx int, k string, probability double"), "k")
    text = evaluation.briefing(found, "k")
    assert "## Watch (1)" in text and "1. a: 0.200 (+0.100)" in text and "2. b: 0.080 (-0.220)" in text and "c" not in text.split("Extended")[1].replace("ecl", "")


def test_stage_weights_sum_to_three(spark):
    rows = [(l, f"F{f}", s, ((l * 7 + f * 13 + s * 5) % 23) / 23) for l in range(20) for f in range(5) for s in (1, 2, 3)]
    got = signals.stage_weights(spark.createDataFrame(rows, "lineage long, front string, signal int, similarity double")).collect()
    assert len(got) == 3 and math.isclose(sum(r.weight for r in got), 3)


def test_command_line(capsys):
    assert main(["list"]) == 0 and "d009_citation_edges" in capsys.readouterr().out
    assert main(["dance"]) == 2
