"""Every query with a DuckDB twin gives its rows, at the smallest scale."""

import os
from datetime import date, datetime

import duckdb
import pytest

from tidemark import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def plain(x):
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return None if x != x else round(x, 4) + 0.0
    if isinstance(x, datetime | date):
        return str(x)[:10]
    return x


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    theirs = ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if not all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4 * max(1, abs(x)) for x, y in zip(a, b, strict=True))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, sf_dir, name):
    """Run to the end: the same rows again, and some."""
    if name in ("d126_changepoint_calibration", "d125_parameter_sweep", "d021_consensus_communities"):
        pytest.skip("grids and ensembles over every setting: their operators have tests of their own")
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_no_python_in_window_queries(spark, sf_dir):
    for name in ("d062_field_metrics", "d089_onsets", "d090_maturations", "d074_disruption", "d042_npmi_pairs"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan, name
