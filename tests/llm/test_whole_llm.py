"""Cases in which an operator for training data once did less than the whole job."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, ngram_join


@pytest.mark.parametrize("blocks", [7, 1024])
def test_small_sources_reach_their_targets(spark, blocks):
    rows = [(i, "w " * 900, "big") for i in range(200)]
    rows += [(1000 + 5 * s + k, "w " * (3 + (s + k) % 9), f"small{s:03d}") for s in range(90) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, blocks=blocks)
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).toPandas()
    small = sums[sums.source != "big"]
    assert len(small) == 90 and (abs(small.taken - small.target) <= 1).all() and (small.taken > 0).all()
    assert got.where("taken > 3 * size").count() == 0
    assert mixing.repeat_by_taken(docs, got).select("source").distinct().count() == 91


def test_null_and_repeated_ids_keep_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    common = " ".join(f"z{i}" for i in range(12))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, a + " end"), (7, "quite another text of few words"), (1, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.without_near_copies(docs, width=5, similarity=(80, 100)).collect()
    # c stays under 1, a under 7 (with its last word), b once
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, b), (7, a + " end"), (7, rows[5][1]), (1, c)])

    lined = [(None, common + "\nfirst own line"), (None, "second own line\n" + common), (3, common), (4, "x one\n" + common), (4, "y two\nz three")]
    out = line_dedup.dedup_lines(spark.createDataFrame(lined, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in out) == [(0, "first own line", 1), (0, "second own line", 1), (3, common, 0), (4, "x one", 1), (4, "y two\nz three", 0)]


def test_sources_six_orders_apart(spark):
    rows = [(i, "w " * 5000, "big") for i in range(200)] + [(1000 + i, "w", f"tiny{i:02d}") for i in range(6)]
    sums = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) <= 0.5 for r in sums.collect())


def test_every_beginning_of_the_schedule_is_mixed(spark):
    rows = [(i, "w " * 100, "abc"[i % 3]) for i in range(300)]
    sized = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("source", "size(split(trim(text), ' ')) AS size")
    slots = mixing.slot_schedule(mixing.source_targets(sized), 64).orderBy("slot").toPandas()
    whole = slots["rank"].value_counts(normalize=True)
    for n in (16, 32, 64):
        begun = slots.head(n)["rank"].value_counts(normalize=True).reindex(whole.index).fillna(0)
        assert (abs(begun - whole) < 0.13).all()
    assert slots.groupby("rank").slot.is_monotonic_increasing.all() and slots.slot.is_unique


def test_clashing_column_names(spark):
    names = ["lines_", "dropped_lines_", "copies_", "copy_", "row_key_", "taken_", "kept_id_", "node", "tidemark"]
    rows = [(i, "one two three four five six seven eight nine ten\nown " + str(i), "s", *names) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert ngram_join.without_near_copies(docs).columns == docs.columns
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == 4


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tidemark.llm.shared import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
