"""The pipeline, stage by stage, on planted documents."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from tidemark.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeiorstnl") for _ in range(rng.randint(3, 8)))
    docs, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(30, 120))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zanquor", "bixelud", "frumpig"]))
        docs.append([i, " ".join(w)])
        labels.append((i, 1, toxic))
    common = " ".join(word() for _ in range(60))
    for i in range(600, 610):
        docs.append([i, " ".join(word() for _ in range(50)) + "\n" + common])
    base = [word() for _ in range(200)]
    for i in range(610, 620):  # near copies: one changed word each
        docs.append([i, " ".join(word() if j == (i - 610) * 15 else x for j, x in enumerate(base))])
    docs += [[620, docs[1][1]], [621, None], [622, ""]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), dict(docs), {i for i, _, t in labels if t}, common


def test_stages(spark, corpus):
    folder, texts, toxic, common = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == columns and len(toxic & kept) <= 2 and len(set(texts) - toxic - kept) <= 2

    lines = stages["line_dedup"](spark, clean, folder)
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == columns and 620 not in got and 621 in got and 622 in got
    assert sum(common in (r.text or "") for r in got.values()) == 1 and all(r.n_chars == len(r.text or "") for r in got.values())

    one = stages["ngram_jaccard"](spark, lines, folder)
    left = {r.doc_id for r in one.select("doc_id").collect()}
    assert one.columns == columns and len(left & set(range(610, 620))) < 10 and left - set(range(600, 620)) == set(got) - set(range(600, 620))

    mixed = stages["source_mix"](spark, one, folder)
    assert mixed.columns == columns and mixed.count() > 0 and {r.doc_id for r in mixed.collect()} <= left

    encoded = stages["sentencepiece"](spark, mixed, folder)
    assert encoded.count() == mixed.count() and encoded.where("NOT restored").count() == 0


def test_stages_on_nothing(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "source_mix", "sentencepiece"]
    assert isinstance(toxicity.MOST_LABELLED, int)
