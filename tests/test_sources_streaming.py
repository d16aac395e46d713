import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning
from tidemark.operators.kernels import run_length_filter
from tidemark.sources import readers, sinks
from tidemark.streaming import events as S


def test_filter_string_and_merge():
    assert readers.filter_string({"a": ["x", None, "y"], "b": "", "c": 3}) == "a:x|y,c:3"
    assert readers.merged({"kind": "csv", "filters": {"a": 1}}, {"filters": {"b": 2}})["filters"] == {"a": 1, "b": 2}


def test_readers(spark, tmp_path):
    pd.DataFrame({"id": [1, 2], "v": ["a", "b"]}).to_csv(tmp_path / "t.csv", index=False)
    df = readers.read(spark, {"kind": "csv", "path": str(tmp_path / "t.csv"), "schema": "id int, v string"})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a"), (2, "b")]
    assert readers.first_available(df, ["ident", "ID"]) == "id"
    assert readers.newer_than(df, "id", 1).count() == 1
    (tmp_path / "w.json").write_text(json.dumps({"id": "u/W1", "publication_year": 2020}))
    assert readers.read(spark, {"kind": "ndjson", "path": str(tmp_path / "w.json")}).first().id == "u/W1"
    with pytest.raises(ValueError, match="unknown source kind"):
        readers.read(spark, {"kind": "tape"})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2020Q1", 1.0), ("2020Q2", 2.0)], "quarter string, value double")
    sinks.write_metric(df, str(tmp_path / "m"), "global")
    sinks.write_manifest(str(tmp_path / "m"), {"level": "global"})
    assert sinks.verify_manifest(str(tmp_path / "m")) == []
    next((tmp_path / "m").glob("part-*")).write_bytes(b"x")
    assert len(sinks.verify_manifest(str(tmp_path / "m"))) == 1
    sinks.write_slices(df, str(tmp_path / "s"), "quarter")
    pruned = spark.read.parquet(str(tmp_path / "s")).where("quarter = '2020Q2'")
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull(quarter" in pruned._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="unknown level"):
        sinks.write_metric(df, str(tmp_path / "x"), "galaxy")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.stamped(S.stream_files(spark, str(tmp_path / "in"), batch.schema), late="60 days")
    q = S.windowed(stream, "1 day").writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.starts, r.event_type): r.n for r in spark.sql("SELECT * FROM daily").collect()}
    want = {(r.starts, r.event_type): r.n for r in S.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 day").collect()}
    assert got == want


def test_stream_changepoints(spark, tmp_path):
    counts = [5] * 10 + [50] * 5
    for part, rows in enumerate((range(8), range(8, 15))):
        spark.createDataFrame([(1, i, counts[i]) for i in rows], "lineage_id int, q_idx int, new_works long").coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"p{part}").glob("part-*")).rename(tmp_path / "in" / f"f{part}.parquet")
    stream = S.stream_files(spark, str(tmp_path / "in"), "lineage_id int, q_idx int, new_works long", files=2)
    q = S.changepoints(stream).writeStream.format("memory").queryName("cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.q_idx: r.changepoint_prob for r in spark.sql("SELECT * FROM cp").collect()}
    want, _ = run_length_filter(pd.Series(counts, dtype=float).to_numpy())
    assert sorted(got) == list(range(15)) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_learning(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 10), float(i % 3), int(i % 10 > 6)) for i in range(200)], "a double, b double, label int")
    model = learning.fit_classifier(rows, ["a", "b"], "label", "logistic")
    registry = learning.ModelRegistry(str(tmp_path / "models"))
    assert registry.save(model, rows.agg(F.count("*").alias("n"))) == 1
    scored = learning.predict(registry.load(), rows)
    assert scored.where("label = 1").agg(F.min("probability")).first()[0] > scored.where("label = 0").agg(F.avg("probability")).first()[0]
    best, means = learning.cross_validated(rows, ["a", "b"], "label", folds=2, regs=(0.01,))
    assert len(means) == 1 and best is not None
