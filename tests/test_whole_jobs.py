"""Queries that run over the whole corpus, against brute force on small tables."""

import hashlib
import random
from datetime import datetime

from tidemark import catalog
from tidemark.plans import graph_plans

D074 = "d074_disruption_all"


def orders_and_items(spark, folder, rows, items):
    """rows: (key, customer, status, date); items: (order, part)."""
    orders = [(k, c, s, d, "1-URGENT", 1000.0) for k, c, s, d in rows]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")


def test_disruption_of_every_work(spark, tmp_path):
    rng = random.Random(3)
    year = {k: rng.randint(1992, 1998) for k in range(1, 61)}
    kind = {k: rng.choice("FFO") for k in year}
    refs = {(rng.randint(1, 60), rng.randint(1, 70)) for _ in range(400)}
    orders_and_items(spark, tmp_path, [(k, k % 5, kind[k], datetime(year[k], 5, 1)) for k in year], sorted(refs))
    want = {}
    for f in (k for k in year if kind[k] == "F"):
        own = {d for s, d in refs if s == f}
        later = {s for s, _ in refs if year[s] > year[f]}
        direct, through = {s for s in later if (s, f) in refs}, {s for s in later if s != f and any((s, d) in refs for d in own)}
        want[f] = (len(direct - through), len(direct & through), len(through - direct))
    got = {r.work_id: (r.n_u, r.n_v, r.n_w) for r in catalog.QUERIES[D074](spark, str(tmp_path)).collect()}
    assert got == want and any(k % 7 for k in got)


def test_every_quarter(spark, sf_dir, monkeypatch):
    quarters = graph_plans._quarters(spark, sf_dir)
    assert len(quarters) > 20
    found = lambda df: sorted(r.q_idx for r in df.select("q_idx").distinct().collect())
    assert found(catalog.QUERIES["d027_lineages"](spark, sf_dir)) == quarters
    assert found(catalog.QUERIES["d028_variation_of_information_all"](spark, sf_dir)) == quarters[1:]
    assert found(catalog.QUERIES["d032_community_sizes_all"](spark, sf_dir)) == quarters
    held = found(graph_plans._quarterly(spark, sf_dir))
    assert held == [q for q in quarters if q >= held[0]] and len(held) > 2
    assert found(catalog.QUERIES["d024_pagerank_cores"](spark, sf_dir)) == held
    asked = {}
    monkeypatch.setattr(graph_plans.C, "detect_communities", lambda *a, **k: asked.update(k))
    catalog.QUERIES["d021_consensus_communities"](spark, sf_dir)
    assert asked["runs"] == 16


def test_texts_of_lineage_and_quarter(spark, tmp_path):
    rows = [(i, f"s{i % 2}", f"t{i}", "en") for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(f"s{q % 2}", q): hashlib.md5(" ".join(f"t{i}" for i in range(900) if i % 8 == q and i < 400).encode()).hexdigest() for q in range(8)}
    got = catalog.QUERIES["d048_quarterly_texts_all"](spark, str(tmp_path)).collect()
    assert {(r.lineage, r.q_idx): r.text_md5 for r in got} == want and all(r.papers == 50 for r in got)
