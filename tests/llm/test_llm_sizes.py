"""What the operators leave on disk and pass on, where that decides how far they go."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, ngram_join, toxicity


def shuffle_files(spark):
    """Sizes of the shuffle files that the session holds."""
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f"{d}/{x}": os.lstat(f"{d}/{x}").st_size for top in folders for d, _, names in os.walk(top.getPath()) for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def test_filters_leave_no_shuffle_files(spark):
    hashes = spark.range(200_000).select(F.xxhash64("id").alias("hash"))
    before = shuffle_files(spark)
    found = ngram_join.Bits(spark, hashes)
    assert sum(size for f, size in shuffle_files(spark).items() if f not in before) < 10_000
    assert found.has(np.array([r.hash for r in hashes.limit(50).collect()])).all()


def linking(rng, n):
    """Two sets of about n hashes at the least similarity that links."""
    common = rng.integers(1, 1 << 63, n, dtype=np.uint64)
    own = rng.integers(1, 1 << 63, int(len(common) * 15 / 85), dtype=np.uint64)
    cut = rng.integers(0, len(own) + 1)
    return np.unique(np.concatenate([common, own[:cut]])), np.unique(np.concatenate([common, own[cut:]]))


def test_links_share_as_many_parts_as_are_asked_for():
    rng = np.random.default_rng(11)
    for n in [*range(1, 60), 100, 127, 128, 129, 250, 511, 512, 700, 1023, 1500, 4000]:
        for _ in range(4):
            a, b = linking(rng, n)
            if np.array_equal(a, b):
                continue
            x, y = (ngram_join.filings(s, 85, 100) for s in (a, b))
            held = [set(np.concatenate([s for s, _ in f]).tolist()) for f in (x, y)]
            passes = [{int(v) for sigs, least in f if len(other.intersection(sigs.tolist())) >= least for v in sigs} for f, other in ((x, held[1]), (y, held[0]))]
            assert passes[0] & passes[1], n


def test_a_shared_passage_does_not_make_a_candidate(spark):
    """Texts of 600 words with a passage of 60 in common share some parts, but not as many as a link needs."""
    rng = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{v}" for v in rng.integers(0, 10**9, 540)])) for i in range(60)]
    rows.append((99, rows[0][1].rsplit(" ", 8)[0]))
    nodes = ngram_join.document_nodes(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100), "doc_id", "text").cache()
    sigs = nodes.select("node", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.countDistinct("node").alias("n")).where("n > 1").select("sig")
    assert sigs.join(nodes.select("node", F.explode("sigs").alias("sig")), "sig").select("node").distinct().count() > 30
    kept = {r.node for r in ngram_join._wanted_signatures(nodes, ngram_join.Bits(spark, sigs)).select("node").distinct().collect()}
    ids = {r.doc_id for r in nodes.collect() if r.node in kept}
    assert {0, 99} <= ids and len(ids) < 10


def test_a_large_group_of_near_copies_asks_few_tiles(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = []
    for i in range(400):  # one to three changed words each: most link with some copies, not with all
        at = rng.sample(range(200), 1 + i % 3)
        texts.append(" ".join(word() if j in at else w for j, w in enumerate(base)))
    monkeypatch.setattr(ngram_join, "GROUP_MEMBERS", 8)
    monkeypatch.setattr(ngram_join, "TILE_MEMBERS", 50)
    routes, write = [], ngram_join.materialize

    def counted(df, label, *more):
        out = write(df, label, *more)
        if label == "routes":
            routes.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    found = ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    main = Counter(r.component_id for r in found).most_common(1)[0][1]
    assert main > 150
    # Each node may ask one tile; all tiles only those that stay outside the main component.
    assert sum(routes) <= 400 + (400 - main) * -(-400 // 50)


def test_frequent_signatures_meet_no_tiles_one_by_one(spark):
    """100 components of one clump share 40 signatures, in 5 tiles: routes come of the nodes, not of nodes x signatures x tiles."""
    left = spark.range(4000).selectExpr("id % 40 AS sig", "id DIV 40 AS node", "id DIV 40 AS root")
    placed = spark.range(100).selectExpr("id AS node", "id AS root", "0L AS kind", "id % 5 AS tile", "5L AS tiles", "id > 0 AS asks")
    routes = ngram_join._routes(left, placed, False)
    assert {(r.q_node, r.tile) for r in routes.collect()} == {(n, t) for n in range(1, 100) for t in range(5)} and routes.count() == 495
    assert ngram_join._routes(left, placed, True).count() == 99
    rare = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 2, 2), (2, 8, 8), (3, 3, 3), (3, 13, 13)], "sig long, node long, root long")
    assert {(r.q_node, r.tile) for r in ngram_join._routes(rare, placed.where("node in (1, 2, 3, 8, 13)"), False).collect()} == {(1, 2), (2, 1), (2, 3), (8, 2), (3, 3), (13, 3)}


def test_variants_of_lines_carry_no_document_keys(spark, monkeypatch):
    """Some 2 n variants of a line of n words are sorted and shuffled: they are two numbers and a kind, whatever the ids are."""
    seen, make = [], line_dedup._variant_rows
    monkeypatch.setattr(line_dedup, "_variant_rows", lambda near: seen.append(make(near)) or seen[-1])
    words = [f"w{i}" for i in range(12)]
    rows = [("a" * 30, " ".join(words)), ("b" * 30, " ".join([*words[:5], "other", *words[6:]])), ("c" * 30, " \t\r\n" + " ".join(words[1:]) + "\n\n x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id[0]: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {"a": (rows[0][1], 1, 0), "b": ("", 1, 1), "c": (" \t\r\n\n x", 2, 1)}
    assert [f.dataType.simpleString() for f in seen[0].schema] == ["bigint", "bigint", "tinyint"]
    same_place = spark.createDataFrame([(7, rows[0][1]), (7, rows[1][1])], "doc_id long, text string")
    assert line_dedup.repeated_lines(same_place).collect() == []  # neither is earlier


def test_variants_of_lines_are_not_broadcast(spark, monkeypatch):
    """The optimiser takes the variants to be as large as the lines they are made of."""
    plans, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or write(df, label))
    line_dedup.repeated_lines(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"))
    joins = re.findall(r"(\w+Join) \[(key|pos|h1)#", plans["line-repeats"])
    assert sorted(joins) == [("SortMergeJoin", "h1"), ("SortMergeJoin", "key"), ("SortMergeJoin", "pos")]


def test_a_part_of_the_signatures_is_on_disk_at_a_time(spark, monkeypatch):
    """Signatures and shingles meet in passes, each of some of them, and stored signatures are gone before texts are read again."""
    seen, write, drop = [], ngram_join.materialize, ngram_join.drop_table
    monkeypatch.setattr(ngram_join, "materialize", lambda df, label, *more: (out := write(df, label, *more), seen.append((label, out.collect() if label == "several" else None)))[0])
    monkeypatch.setattr(ngram_join, "drop_table", lambda spark, df: seen.append(("drop", df.columns)) or drop(spark, df))
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-2], "x"])), (3, "other words of one text"), (4, " ".join(words))]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 1}
    parts = [[r[0] for r in found] for label, found in seen if label == "several"]
    assert len(parts) == 8 and all(len({h % 4 for h in part}) == 1 for part in parts)
    assert any("sigs" in columns for label, columns in seen[: [label for label, _ in seen].index("near")] if label == "drop")


def components_by(spark, monkeypatch, edges, at_once):
    """Roots by node, and how often edges were written."""
    written, write = [], ngram_join.materialize
    with monkeypatch.context() as patch:
        patch.setattr(ngram_join, "EDGES_AT_ONCE", at_once)
        patch.setattr(ngram_join, "materialize", lambda df, label, *more: written.append(label) or write(df, label, *more))
        found = ngram_join.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    return {r.node: r.root for r in found}, len(found), len(written)


def test_few_edges_are_joined_without_rounds_of_shuffles(spark, monkeypatch):
    rng = random.Random(9)
    path = rng.sample(range(-400, 400), 800)
    edges = list(zip(path[:500], path[1:501], strict=True)) + [(x, x) for x in path[500:510]]
    edges += [(rng.choice(path[520:]), rng.choice(path[520:])) for _ in range(150)] * 2
    trees = ngram_join.Forest()
    for a, b in edges:
        trees.join(a, b)
    want = {x: trees.find(x) for e in edges for x in e if trees.find(x) != x}
    for at_once in (1 << 20, 100):  # in one task, and by rounds
        got, rows, written = components_by(spark, monkeypatch, edges, at_once)
        assert got == want and rows == len(want)
        assert written <= 2 or at_once == 100


def test_rare_words_do_not_push_out_frequent_ones(monkeypatch):
    """Values of a worker's frequent words are computed twice at most, however many rare ones come between."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abdeilmnorstu") for _ in range(n))
    landmarks, frequent = ["idiot", "moron", "disturbed"], [word(7) for _ in range(60)] + ["idiots", "m-o-r-o-n", "undisturbedmoronidiots"]
    blocks = [pa.array([" ".join(frequent + [word(9) for _ in range(50)]), None, " i d i o t s " + word(8), ""]) for _ in range(20)]
    want = [toxicity.Reader(landmarks).read(b) for b in blocks]
    compared, compare = Counter(), toxicity.Landmarks.compare
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 100)
    monkeypatch.setattr(toxicity.Landmarks, "compare", lambda self, words: compared.update(words) or compare(self, words))
    reader = toxicity.Reader(landmarks)
    assert all(np.array_equal(reader.read(b), w) for b, w in zip(blocks, want, strict=True))
    assert len(reader.place) <= 100 and max(compared[w] for w in [*frequent, "idiots"]) <= 2
    monkeypatch.setattr(toxicity, "MOST_ANEW", 200)  # a full store that is told to forget learns afresh
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 10)
    reader = toxicity.Reader(landmarks)
    assert all(np.array_equal(reader.read(b), w) and len(reader.place) <= 10 for b, w in zip(blocks, want, strict=True))
    assert compared["idiots"] > 4
