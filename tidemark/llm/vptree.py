"""Nearest neighbours by largest inner product: vantage-point trees per shard.

A tree splits its points by the median distance to a vantage point. By the triangle inequality all of a half lies at least b from
a query, and as 2 q.x = |q|^2 + |x|^2 - |q - x|^2, none of it has an inner product over (|q|^2 + M^2 - b^2) / 2 with it, nor over
|q| M, M being the half's largest norm, nor over q.c + |q| r, c and r being the half's centre and radius. A half is skipped if that is less than the k-th best product so far. The bound is relaxed
by a factor, b counting factor-fold and r as much less: factor 1 is exact, larger factors skip more. Rows of like norm go together first, so that a few
very long vectors loosen no one else's bound.

The same bound sends queries to shards: rows go to the leaves of a tree over a bounded sample, a query is answered in its own shard
first, and then visits only the leaves that its k-th product there can't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_table, materialize, nonempty, settled

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 8192, 256
#: Rows that the routing tree is fitted on, its leaves and its first vantage points, at most; and dimensions that get a tree.
SAMPLE_ROWS, ROUTING_LEAVES, PIVOTS, DIMENSIONS = 4096, 64, 8, 16
#: Bands of norms (powers of two around the sample's median norm); what lies further out goes to the last ones.
BANDS = 12
#: Rounding: products and squared distances of n components err by less than this share of the squared norms times n.
ERROR = 4e-16


@dataclass
class Node:
    """A leaf holds rows; an inner node a vantage point, the distances to it on either side, the largest norms there, centres and radii, and two halves."""

    rows: np.ndarray
    point: np.ndarray | None = None
    inside: tuple[float, float, float] = (0.0, 0.0, 0.0)
    outside: tuple[float, float, float] = (0.0, 0.0, 0.0)
    centres: np.ndarray | None = None
    radii: tuple[float, float] = (0.0, 0.0)
    near: Node | None = None
    far: Node | None = None


def build_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF_ROWS) -> Node:
    """Splits by rank, so that equal points still fall into halves of equal size."""
    rows = np.arange(len(points)) if rows is None else rows
    if len(rows) <= leaf:
        return Node(rows)
    own = points[rows]
    point = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
    distance = np.sqrt(((own - point) ** 2).sum(axis=1))
    norm = np.sqrt((own**2).sum(axis=1))
    order = np.argsort(distance, kind="stable")
    half = len(rows) // 2
    a, b = order[:half], order[half:]
    sides = [(float(distance[x].min()), float(distance[x].max()), float(norm[x].max())) for x in (a, b)]
    centres = np.stack([own[x].mean(axis=0) for x in (a, b)])
    radii = tuple(float(np.sqrt(((own[x] - c) ** 2).sum(axis=1).max())) for x, c in zip((a, b), centres, strict=True))
    return Node(rows, point, *sides, centres, radii, build_tree(points, rows[a], leaf), build_tree(points, rows[b], leaf))


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def most_product(length: np.ndarray, apart: np.ndarray, norm: np.ndarray | float, factor: float, n: int) -> np.ndarray:
    """No vector up to norm that lies so far apart from a query of this length has a larger inner product with it (for factor 1)."""
    square = length**2 + norm**2
    return np.minimum((square - (factor * apart) ** 2) / 2, length * norm) + ERROR * n * square


class Search:
    """The k best of a tree's points for a block of queries at once. Selection is by the exact inner product, ties by id."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int, factor: float):
        self.points, self.ids, self.queries, self.query_ids, self.k, self.factor = points, ids, queries, query_ids, k, factor
        self.norm = np.sqrt((points**2).sum(axis=1))
        self.length = np.sqrt((queries**2).sum(axis=1))
        self.least = floor.copy()  # what a product must reach
        self.score = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1)

    def visit(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.point is None:
            for at in range(0, len(active), 1024):
                self._scan(node.rows, active[at : at + 1024])
            return
        d = np.sqrt(((self.queries[active] - node.point) ** 2).sum(axis=1))
        slack = ERROR * self.points.shape[1] * (self.length[active] + node.outside[1] + d)
        bounds = [most_product(self.length[active], np.maximum(np.maximum(d - high, low - d) - slack, 0), norm, self.factor, self.points.shape[1]) for low, high, norm in (node.inside, node.outside)]
        reach = self.queries[active] @ node.centres.T + self.length[active][:, None] * np.array(node.radii) / self.factor
        reach += ERROR * self.points.shape[1] * self.length[active][:, None] * (np.sqrt((node.centres**2).sum(axis=1)) + node.radii)
        bounds = [np.minimum(b, r) for b, r in zip(bounds, reach.T, strict=True)]
        first_near = bounds[0] >= bounds[1]
        for near_turn in (True, False):
            for child, bound, mine in ((node.near, bounds[0], first_near == near_turn), (node.far, bounds[1], first_near != near_turn)):
                self.visit(child, active[mine & ~(bound < self.least[active])])

    def _scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        found, q = self.points[rows], self.queries[active]
        rough = q @ found.T
        own = self.query_ids[active][:, None] == self.ids[rows][None, :]
        rough[own] = -np.inf
        slack = 2 * ERROR * found.shape[1] * self.length[active] * self.norm[rows].max()
        least = self.least[active]
        if rough.shape[1] > self.k:
            least = np.maximum(least, np.partition(rough, -self.k, axis=1)[:, -self.k] - slack)
        which, place = np.nonzero(~own & ~(rough < (least - slack)[:, None]))
        if not len(which):
            return
        # What may be among the k best is multiplied exactly and ranked with the k best so far.
        row = rows[place]
        exact = inner_products(q[which], self.points[row])
        held = self.row[active]
        old, at = np.nonzero(held >= 0)
        which, row, exact = np.concatenate([old, which]), np.concatenate([held[old, at], row]), np.concatenate([self.score[active][old, at], exact])
        order = np.lexsort((self.ids[row], -exact, which))
        which, row, exact = which[order], row[order], exact[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        kept = rank < self.k
        target = active[which[kept]], rank[kept]
        self.score[target], self.row[target] = exact[kept], row[kept]
        self.least[active] = np.maximum(self.least[active], self.score[active, -1])


def search_shard(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    """query_id, vec_id and score of each query's k best among the shard's vectors but its own, as far as they reach its floor."""
    search = Search(vectors, ids, queries, query_ids, floor, k, factor)
    search.visit(build_tree(vectors), np.arange(len(queries)))
    q, place = np.nonzero(search.row >= 0)
    return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[search.row[q, place]], "score": search.score[q, place]})


# --- routing -------------------------------------------------------------------------------------


@dataclass
class Router:
    """The top of a vantage-point tree over a sample of one dimension's vectors: (point, median distance) of inner nodes in heap order, pivots and the middle of the norms."""

    splits: dict[int, tuple[np.ndarray, float]]
    pivots: np.ndarray
    middle: float

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int) -> Router:
        splits: dict[int, tuple[np.ndarray, float]] = {}

        def split(rows: np.ndarray, at: int) -> None:
            if len(rows) < 4 or at >= leaves:
                return
            point = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
            d = np.sqrt(((rows - point) ** 2).sum(axis=1))
            cut = float(np.median(d))
            splits[at] = point, cut
            split(rows[d <= cut], 2 * at)
            split(rows[d > cut], 2 * at + 1)

        split(sample, 1)
        pivots = np.array([splits[i][0] for i in sorted(splits)[:PIVOTS]]) if splits else sample[:1]
        return cls(splits, pivots, float(np.median(np.sqrt((sample**2).sum(axis=1)))))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band of norm and leaf of each vector."""
        norm = np.sqrt((x**2).sum(axis=1))
        band = np.clip(np.floor(np.log2(norm / self.middle)), -BANDS, BANDS - 1).astype(np.int32)
        at = np.ones(len(x), dtype=np.int64)
        for _ in range(ROUTING_LEAVES.bit_length()):
            for node in np.unique(at):
                if int(node) in self.splits:
                    point, cut = self.splits[int(node)]
                    mine = at == node
                    at[mine] = 2 * node + (np.sqrt(((x[mine] - point) ** 2).sum(axis=1)) > cut)
        return band, at.astype(np.int32)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of each vector to each pivot; one column for each of PIVOTS."""
        d = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)
        return np.hstack([d, np.zeros((len(x), PIVOTS - d.shape[1]))])


def _placed(rows: DataFrame, routers: dict[int, Router]) -> DataFrame:
    """rows with band, leaf, norm and distances to the pivots (none in dimensions without router)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            dims = batch.column(2).to_numpy()
            n = len(dims)
            band, leaf, norm, far = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros((n, PIVOTS))
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                x = batch.column(1).take(pa.array(mine)).flatten().to_numpy().reshape(-1, dim)
                norm[mine] = np.sqrt((x**2).sum(axis=1))
                if dim in routers:
                    band[mine], leaf[mine] = routers[dim].cells(x)
                    far[mine] = routers[dim].distances(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * PIVOTS + 1, PIVOTS, dtype=np.int32)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band), pa.array(leaf), pa.array(norm), lists], [*batch.schema.names, "band", "leaf", "norm", "far"])

    return rows.select("vec_id", "v", "dim").mapInArrow(settled(place), "vec_id long, v array<double>, dim int, band int, leaf int, norm double, far array<double>")


def _routes(queries: DataFrame, cells: dict[int, dict[str, np.ndarray]], factor: float) -> DataFrame:
    """(query_id, to_band, to_leaf): the cells of its dimension that a query's floor doesn't rule out; the one cell of a dimension without router."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            ids, dims, length, floor = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            far = batch.column(3).flatten().to_numpy().reshape(-1, PIVOTS)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                if dim not in cells:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), *[pa.array(np.zeros(len(mine), np.int32))] * 2], ["query_id", "to_band", "to_leaf"])
                    continue
                c = cells[dim]
                for some in np.array_split(mine, -(-len(mine) * len(c["leaf"]) * PIVOTS // (1 << 20))):
                    apart = np.maximum(far[some][:, None, :] - c["high"], c["low"] - far[some][:, None, :]).max(axis=2)
                    apart -= ERROR * dim * (length[some][:, None] + c["norm"] + c["high"].max(axis=1))
                    bound = most_product(length[some][:, None], np.maximum(apart, 0), c["norm"], factor, dim)
                    q, to = np.nonzero(~(bound < floor[some][:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][q]), pa.array(c["band"][to]), pa.array(c["leaf"][to])], ["query_id", "to_band", "to_leaf"])

    return queries.select("vec_id", "dim", "norm", "far", "floor").mapInArrow(settled(route), "query_id long, to_band int, to_leaf int")


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list())


FOUND = "query_id long, vec_id long, score double"


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})


def nearest_inner_products(
    vectors: DataFrame, query_every: int = 20, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """The k nearest rows by inner product of every row whose id is divisible by query_every: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller id; a row is not its own neighbour (rows of one id are one vector: the one of least
    hash). Vectors that are null, empty, zero or hold null or non-finite components, and rows with null ids, take no part;
    vectors of other dimensions are no candidates. All candidates are returned if fewer than k; an empty table gives no rows;
    other columns play no part. Factor 1 finds exactly the k largest products, summed in double precision from the first
    component to the last; so does any order of norms.

    Every row is indexed. Of each of the DIMENSIONS commonest lengths in a sample of SAMPLE_ROWS rows of least id hash, the sample
    gives a routing tree; cells are its leaves, apart by bands of norm, and cells of many rows are dealt by id hash to shards of
    about shard_rows rows. A query is answered in its own shard; its k-th product is its floor elsewhere, and it goes to the shards
    of those cells which the floor doesn't rule out, in blocks of about query_rows. Where nothing can be ruled out, as with
    vectors without structure, every query still meets every shard: the work is that of the query set against all rows, in blocks.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    sound = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))
    rows = rows.groupBy("vec_id").agg(F.min_by(F.struct("v", "dim"), F.xxhash64("v")).alias("x")).select("vec_id", "x.v", "x.dim")
    rows = materialize(rows, "vectors")

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v", "dim").toPandas()
    leaves = 1 << max(0, min(ROUTING_LEAVES, rows.count() // shard_rows) - 1).bit_length()
    routers: dict[int, Router] = {}
    for dim in sample["dim"].value_counts(sort=True).index[:DIMENSIONS]:
        routers[int(dim)] = Router.fit(_stack(sample.loc[sample["dim"] == dim, "v"]), leaves)
    placed = materialize(_placed(rows, routers), "placed")
    cell = ["dim", "band", "leaf"]
    extent = [F.max("norm").alias("norm"), *[f(F.col("far")[i]).alias(f"{n}{i}") for i in range(PIVOTS) for f, n in ((F.min, "low"), (F.max, "high"))]]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"), *extent)
    sizes = materialize(sizes, "cells")
    # One row for each cell of a sampled dimension: 2 * BANDS * ROUTING_LEAVES * DIMENSIONS at most.
    known = sizes.where(F.col("dim").isin(list(routers))).toPandas()
    cells = {}
    for dim, own in known.groupby("dim"):
        low, high = (own[[f"{n}{i}" for i in range(PIVOTS)]].to_numpy() for n in ("low", "high"))
        cells[int(dim)] = {"band": own["band"].to_numpy(np.int32), "leaf": own["leaf"].to_numpy(np.int32), "norm": own["norm"].to_numpy(), "low": low, "high": high}

    shards = placed.join(sizes.select(*cell, "shards"), cell).withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards"))

    def at_home(group: pd.DataFrame) -> pd.DataFrame:
        asks = group[group["vec_id"] % query_every == 0]
        if not len(asks):
            return _nothing()
        return search_shard(_stack(group["v"]), group["vec_id"].to_numpy(), _stack(asks["v"]), asks["vec_id"].to_numpy(), np.full(len(asks), -np.inf), k, factor)

    home = shards.select(*cell, "shard", "vec_id", "v").groupBy(*cell, "shard").applyInPandas(at_home, FOUND)
    home = materialize(home, "home")
    floors = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    queries = shards.where(F.col("vec_id") % query_every == 0).join(floors, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
    queries = materialize(queries.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "queries")

    routes = _routes(queries, cells, factor).withColumnsRenamed({"to_band": "band", "to_leaf": "leaf"})
    asked = queries.select(F.col("vec_id").alias("query_id"), "dim", F.struct("band", "leaf", "shard").alias("own"), F.col("v").alias("q"), "floor")
    routes = routes.join(asked.select("query_id", "dim", "own"), "query_id").join(sizes.select(*cell, "shards"), cell)
    routes = routes.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).where(F.struct("band", "leaf", "shard") != F.col("own"))
    routes = materialize(routes.select("query_id", *cell, "shard"), "routes")
    blocks = routes.groupBy(*cell, "shard").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("blocks"))
    block = F.pmod(F.xxhash64("query_id"), "blocks")
    visits = routes.join(blocks, [*cell, "shard"]).select("query_id", *[F.col(c).alias(f"q_{c}") for c in (*cell, "shard")], block.alias("q_block"))
    visits = visits.join(asked.select("query_id", "q", "floor"), "query_id")
    opened = shards.join(blocks, [*cell, "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = [*cell, "shard", "block"]

    def search(shard: pd.DataFrame, visit: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(visit):
            return _nothing()
        return search_shard(_stack(shard["v"]), shard["vec_id"].to_numpy(), _stack(visit["q"]), visit["query_id"].to_numpy(), visit["floor"].to_numpy(), k, factor)

    abroad = opened.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(visits.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(search, FOUND)
    drop_table(spark, rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.union(abroad).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
