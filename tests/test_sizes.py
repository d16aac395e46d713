"""Plans and memory that have to hold at sizes which the test tables do not reach."""

import tracemalloc

import numpy as np
import pytest

from tidemark import catalog
from tidemark.operators import communities, partitions

SELF_JOINS = ["d025_core_matches", "d025_core_overlaps_all", "d026_overlap_events_all", "d027_lineages", "d029_core_overlap", "d030_label_change_all", "d024_pagerank_cores"]


class Asked(Exception):
    """Carries the overlaps that a query was going to match."""


def _asked(overlaps):
    raise Asked(overlaps)


@pytest.mark.parametrize("name", SELF_JOINS)
def test_exploded_works_are_not_broadcast(spark, sf_dir, monkeypatch, name):
    """The optimiser takes works exploded over quarters for as small as the works, so it would broadcast them."""
    if name in ("d027_lineages", "d029_core_overlap"):  # these fold the matches on the driver; the join is in the overlaps
        monkeypatch.setattr(communities, "match_cores", _asked)
        with pytest.raises(Asked) as asked:
            catalog.QUERIES[name](spark, sf_dir)
        frame = asked.value.args[0]
    else:
        frame = catalog.QUERIES[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line and "q_idx" in line and "work_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_memory_of_communities():
    """A quarter's graph takes some 200 bytes an edge while it is clustered, not the dictionaries of its nodes."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 20_000, 30_000), rng.integers(0, 2_000, 30_000)
    tracemalloc.start()
    label = partitions.potts_communities(partitions.symmetric(a, b, np.ones(len(a)), 20_000), 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(label) == 20_000 and peak < 250 * len(a)


def test_local_moves_make_no_arrays_for_each_node():
    """A node is visited many times in 17 clusterings: arrays of a few numbers each would take most of the time."""
    taken = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            taken.append(at)
            return super().__getitem__(at)

    rng = np.random.default_rng(4)
    near = partitions.symmetric(rng.integers(0, 300, 900).astype(np.int32), rng.integers(0, 300, 900).astype(np.int32), np.ones(900), 300)
    want = partitions._local_moves(near, np.ones(300), 0.1, np.random.default_rng(1))
    near.to, near.weight = near.to.view(Counted), near.weight.view(Counted)
    got = partitions._local_moves(near, np.ones(300), 0.1, np.random.default_rng(1))
    assert np.array_equal(got, want) and len(np.unique(got)) < 300 and not taken
