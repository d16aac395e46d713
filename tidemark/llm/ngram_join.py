"""N-gram Jaccard join over a token-group matrix, down to connected components.

The join is exact and never forms the pairs of a group of copies:

1. Every text becomes the sorted array of its distinct shingle hashes; equal sets are one node.
2. Blocking: two sets of similarity t differ in at most k shingles, so of k + 1 + e hash-chosen parts of the shingle universe
   at least e + 1 hold the same shingles in both. A part's content hash is a signature; only nodes that share a signature
   can link. Frequent shingles make no frequent signatures, so there is no shingle whose documents meet all at once.
3. The coarsest row of the token-group matrix, the union of all other sets, rules out the nodes that have too many shingles of
   their own. The others are partitioned into groups of similar documents (by the least node they share a signature with, cut to
   a bounded number of shingles); a group's rows of the matrix are the unions of its members' shingles, in subgroups.
4. A query's overlap with a union bounds its overlap with every member. Only qualifying subgroups are opened and their members
   verified exactly. First each group queries itself. What still shares a signature with another component is laid out in
   tiles, and the nodes outside the main component of their surroundings query those tiles that hold one of their signatures
   under another component; members of a main component are not compared again. Surroundings of several tiles are queried at
   one of them first: what it links joins the main component, and only the rest is laid out again and queries all tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import column, drop_table, give_back, hash_shingles, hash_words, large, materialize, mix, nonempty, row_key, settled, text_blocks

#: Fixed size of the filter of possible signatures and nodes; when it fills up it only lets more rows through.
FILTER_BITS = 27
GROUP_MEMBERS, GROUP_SHINGLES, SUBGROUP = 256, 1 << 17, 8
#: Members and queries of a tile that meet in one group, and members whose rows of the matrix are held at once.
TILE_MEMBERS, QUERY_BLOCK, MATRIX_ROWS = 1024, 512, 128
#: Edges that one task joins in its memory (16 MB, and some ten times that for the work).
EDGES_AT_ONCE = 1 << 20
#: Passes over signatures and shingles, by their last bits. A power of two.
HASH_PASSES = 4


def shingle_sets(block: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    words, bounds = hash_words(block)
    shingles, at = hash_shingles(words, bounds, width)
    return [np.unique(shingles[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def node_of(tokens: np.ndarray) -> int | None:
    """A 64-bit hash of a set; null for the empty set."""
    if not len(tokens):
        return None
    total = np.add.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))
    return int(mix(np.array([total + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)[0])


@cache
def size_classes(n: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(class, most differing shingles k, parts m, seed) under which a set of n shingles is filed.

    A class holds the sizes in (r/2, r] for a power of two r; sizes near a boundary are also filed in the class that bridges
    it, so that two sizes that can link share a class.
    """
    found = []
    top = (n - 1).bit_length()
    found.append((2 * top, 1 << top, (1 << top) // 2 + 1))
    for j in (top - 1, top):
        edge = 1 << j if j >= 0 else 0
        if edge and den * n >= num * edge and num * n <= den * edge:
            found.append((2 * j + 1, den * edge // num, -(-num * edge // den)))
    out = []
    for label, most, least in found:
        k = 2 * most * (den - num) // (den + num)
        if k:  # otherwise only equal sets link
            out.append((label, k, _parts(k, least), label))
    return out


@cache
def _parts(k: int, least: int) -> int:
    """k + 1 parts and as many more as will be empty for most sets of the class."""
    m = k + 1
    for _ in range(8):
        empty = m * (1 - 1 / m) ** least if m > 1 else 0
        m = k + 1 + int(np.ceil(1.1 * empty + np.sqrt(empty)))
    return m


def filings(tokens: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, int]]:
    """Content hashes of the parts of a set, filing by filing, and how many of them a set that links with this one has at least.

    A set with more empty parts than the class allows is filed again with another seed: of two linking sets, both are filed
    under the first seed that suits either of them, and there they share a part that is not empty. As at most k parts differ,
    they share all parts there but k, of which no more are empty than this set has empty ones.
    """
    value = mix(tokens)
    found = []
    for label, k, m, _ in size_classes(len(tokens), num, den):
        for seed in range(64):
            salt = np.uint64((label * 64 + seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            part = ((mix(value + salt) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            filled = np.flatnonzero(np.bincount(part, minlength=m))
            sums = np.zeros(m, dtype=np.uint64)
            np.add.at(sums, part, value)
            found.append((mix(sums[filled] ^ mix(filled.astype(np.uint64) + salt)), max(1, len(filled) - k)))
            if m - len(filled) <= m - k - 1:
                break
        else:
            raise ValueError("no seed spreads this set over its parts")
    return found


def signatures(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """The content hashes of all filings of a set."""
    found = filings(tokens, num, den)
    return np.concatenate([sigs for sigs, _ in found]).view(np.int64) if found else NOTHING


NOTHING = np.zeros(0, dtype=np.int64)


class Bits:
    """A fixed-size filter of 64-bit hashes: lets through all that are in it and some that are not."""

    def __init__(self, spark: SparkSession, hashes: DataFrame):
        bits = hashes.select((F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))).alias("bit"))
        words = bits.groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits"))
        words = materialize(words, "bits")  # so that the shuffle files of hashes go at once
        got = words.toArrow()  # 2 ** (FILTER_BITS - 6) rows at most
        drop_table(spark, words)
        table = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
        table[got["word"].to_numpy()] = got["bits"].to_numpy()
        self.table = spark.sparkContext.broadcast(table)
        del got, table
        give_back()

    def drop(self) -> None:
        """The filter is not asked again."""
        self.table.destroy()
        give_back()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes & np.int64((1 << FILTER_BITS) - 1)
        return (self.table.value[bit >> 6] >> (bit & 63)) & 1 == 1


def _row_keys(id_hashes: np.ndarray, nodes: list[int | None]) -> np.ndarray:
    """A hash of each row's id and node; null nodes count as 0."""
    node = np.array([0 if n is None else n for n in nodes], dtype=np.int64).view(np.uint64)
    return mix(mix(id_hashes.view(np.uint64)) + node).view(np.int64)


def _each_set(batches: Iterator[pa.RecordBatch], width: int, first_rows: Bits) -> Iterator[tuple[int, np.ndarray]]:
    """Each node with its set, from the row that stands for it, and once for a task where the filter lets others through."""
    seen: set[int] = set()
    for batch in nonempty(batches):
        id_hashes = batch.column(0).to_numpy()
        for first, block in text_blocks(column(batch, "text")):
            sets = shingle_sets(block, width)
            nodes = [node_of(s) for s in sets]
            wanted = first_rows.has(_row_keys(id_hashes[first : first + len(block)], nodes))
            for node, tokens, stands in zip(nodes, sets, wanted.tolist(), strict=True):
                if stands and node is not None and node not in seen:
                    seen.add(node)
                    yield node, tokens


def _wanted_signatures(rows: DataFrame, wanted: Bits) -> DataFrame:
    """(sig, node) of the stored signatures that the filter lets through, of filings where it lets as many through as a link needs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            lists = batch.column(1)
            sigs = lists.flatten().to_numpy()
            kept = wanted.has(sigs)
            size, least = batch.column(2).flatten().to_numpy().reshape(-1, 2).T
            ends, held = np.cumsum(size), np.concatenate([[0], np.cumsum(kept)])
            kept &= np.repeat(held[ends] - held[ends - size] >= least, size)
            nodes = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(sigs[kept]), pa.array(nodes[kept])], ["sig", "node"])

    return rows.where("size(sigs) > 0").select("node", "sigs", "filed").mapInArrow(settled(emit), "sig long, node long")


def _in_passes(hashes: DataFrame, several: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """several(hashes), which looks at each hash (the first column) by itself, in HASH_PASSES passes: the shuffle of one is on disk at a time."""
    found = None
    for p in range(HASH_PASSES):
        part = materialize(several(hashes.where(F.col(hashes.columns[0]).bitwiseAND(F.lit(HASH_PASSES - 1)) == p)), "several")
        found = part if found is None else found.union(part)
    return found


def _shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, node) of the stored signatures that several nodes have, of filings where the filter lets as many through as a link needs."""
    pairs = rows.select(F.explode("sigs").alias("sig"), "node")
    met = _in_passes(pairs, lambda mine: mine.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("sig"))
    in_met = Bits(rows.sparkSession, met)
    shared = materialize(large(_wanted_signatures(rows, in_met)).join(met, "sig").select("sig", "node").distinct(), "shared")
    in_met.drop()
    drop_table(rows.sparkSession, met)
    return shared


def _set_rows(texts: DataFrame, width: int, first_rows: Bits, wanted: Bits) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, held = [], [], 0
        for node, tokens in _each_set(batches, width, first_rows):
            if not wanted.has(np.array([node]))[0]:
                continue
            nodes.append(node)
            sets.append(tokens.view(np.int64))
            held += len(tokens)
            if held > 1 << 18:
                yield batch_of(nodes, sets)
                nodes, sets, held = [], [], 0
        if nodes:
            yield batch_of(nodes, sets)

    def batch_of(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["node", "tokens"])

    return texts.mapInArrow(settled(emit), "node long, tokens array<long>")


def document_nodes(docs: DataFrame, width: int, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, node (null without words), key (of id and node), sigs and filed (size and least of each filing) of each row; of equal sets in one task only the first has sigs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int | None] = {None}
        for batch in nonempty(batches):
            id_hashes = batch.column(1).to_numpy()
            for first, block in text_blocks(column(batch, "text")):
                sets = shingle_sets(block, width)
                nodes = [node_of(s) for s in sets]
                filed = [filings(s, *similarity) if not (n in seen or seen.add(n)) else [] for s, n in zip(sets, nodes, strict=True)]
                sigs = [np.concatenate([x for x, _ in f]).view(np.int64) if f else NOTHING for f in filed]
                keys = _row_keys(id_hashes[first : first + len(block)], nodes)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
                arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs)))]
                arrays.append(pa.array([[y for x, least in f for y in (len(x), least)] for f in filed], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), *arrays], ["doc_id", "n_shingles", "node", "key", "sigs", "filed"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col).alias("id_hash"), F.col(text_col).alias("text"))
    return source.mapInArrow(settled(emit), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long, key long, sigs array<long>, filed array<int>")


# --- the token-group matrix ----------------------------------------------------------------------


def qualifying_links(queries: list[np.ndarray], members: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) index arrays of the links den * |intersection| >= num * |union| between sorted distinct arrays, MATRIX_ROWS members at a time."""
    for at in range(0, len(members), MATRIX_ROWS):
        for q, m in _matrix_links(queries, members[at : at + MATRIX_ROWS], num, den):
            yield q, m + at


def _matrix_links(queries: list[np.ndarray], members: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members are ordered by least shingle and size, so that similar ones fall into the same subgroup. A row of the matrix is a
    subgroup's token union; a query opens the subgroup only if the row holds num/den of the query's shingles.
    """
    vocabulary = np.unique(np.concatenate(members))
    size = np.array([len(m) for m in members])
    order = np.lexsort((size, [m[0] for m in members]))
    matrix = np.zeros((len(members), len(vocabulary)), dtype=np.float32)  # MATRIX_ROWS x GROUP_SHINGLES cells at most
    for row, i in enumerate(order):
        matrix[row, np.searchsorted(vocabulary, members[i])] = 1
    begins = np.arange(0, len(members), SUBGROUP)
    unions = np.maximum.reduceat(matrix, begins, axis=0)
    size = size[order]
    step = max(1, min(len(queries), (1 << 24) // max(1, len(vocabulary))))
    for first in range(0, len(queries), step):
        block = queries[first : first + step]
        lengths = np.array([len(q) for q in block])
        asked = np.zeros((len(block), len(vocabulary)), dtype=np.float32)
        for row, q in enumerate(block):
            at = np.minimum(np.searchsorted(vocabulary, q), len(vocabulary) - 1)
            asked[row, at[vocabulary[at] == q]] = 1
        opens = den * (asked @ unions.T).astype(np.int64) >= num * lengths[:, None]
        for g in np.flatnonzero(opens.any(axis=0)):
            rows, cols = np.flatnonzero(opens[:, g]), np.arange(begins[g], min(begins[g] + SUBGROUP, len(members)))
            common = (asked[rows] @ matrix[cols].T).astype(np.int64)
            union = lengths[rows][:, None] + size[cols][None, :] - common
            q, m = np.nonzero(den * common >= num * union)
            if len(q):
                yield first + rows[q], order[cols[m]]


class Forest:
    """Union-find over any keys; the least key of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while (above := self.up.get(x, x)) != root:
            self.up[x], x = root, above
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _arrays(tokens: pd.Series) -> list[np.ndarray]:
    return [np.asarray(t, dtype=np.int64).view(np.uint64) for t in tokens]


def _after(sets: list[np.ndarray]) -> None:
    """A large group's worker gives its memory back."""
    if sum(map(len, sets)) > 1 << 15:
        give_back()


def _own_links(num: int, den: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        sets, nodes, forest, edges = _arrays(group["tokens"]), group["node"].tolist(), Forest(), []
        for q, m in qualifying_links(sets, sets, num, den):
            edges += [(nodes[i], nodes[j]) for i, j in zip(q.tolist(), m.tolist(), strict=True) if i != j and forest.join(nodes[i], nodes[j])]
        _after(sets)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return links


def _other_links(num: int, den: int):
    def links(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        members, edges, forest = members.drop_duplicates("node"), [], Forest()
        if len(members) and len(queries):
            m_node, m_root, q_node, q_root = (x.tolist() for x in (members["node"], members["root"], queries["q_node"], queries["q_root"]))
            sets = _arrays(members["tokens"])
            for q, m in qualifying_links(_arrays(queries["q_tokens"]), sets, num, den):
                edges += [(q_node[i], m_node[j]) for i, j in zip(q.tolist(), m.tolist(), strict=True) if forest.join(q_root[i], m_root[j])]
            _after(sets)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return links


# --- components ----------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edges (a, b) but the roots; a root is the least node of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, (x, y) = np.arange(len(nodes)), ends.reshape(2, -1)
    while True:
        x, y = up[x], up[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))  # roots only, as up is flat here
        while (up != (above := up[up])).any():
            up = above
    below = np.flatnonzero(up != np.arange(len(up)))
    return nodes[below], nodes[up[below]]


def _forests(edges: DataFrame) -> DataFrame:
    """(hi, lo): edges that join the same nodes as the edges (a, b), a forest for each EDGES_AT_ONCE of a task. Narrow."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in nonempty(batches):
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            rows += batch.num_rows
            if rows > EDGES_AT_ONCE:
                yield joined(held)
                held, rows = [], 0
        if held:
            yield joined(held)

    def joined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*np.concatenate(held, axis=1))], ["hi", "lo"])

    return edges.mapInArrow(settled(emit), "hi long, lo long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; a root is the least node of its component.

    Each task joins what its own edges link. If all tasks together leave EDGES_AT_ONCE edges or fewer, one task joins them, as
    rounds of shuffles would take longer than they have work. Otherwise alternating large-star and small-star steps do so; edges
    are written to the shared folder after each round. Minima are taken by map-side aggregates and joined back, so that a node
    with very many neighbours is no task of its own.
    """
    spark = edges.sparkSession
    current = materialize(_forests(edges), "edges")
    if current.count() <= EDGES_AT_ONCE:
        before, current = current, materialize(_forests(current.coalesce(1)), "edges")
        drop_table(spark, before)
        return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    state = None
    while True:
        now = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if now == state or not now[0]:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small, "hi")
        stars = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", F.col("m").alias("lo"))).distinct()
        before, current = current, materialize(stars, "edges")
        drop_table(spark, before)


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (sig, node, root) of signatures that several roots share."""
    several = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    return rows.join(several, "sig").select("sig", "node", "root")


def _in_two(sets: DataFrame) -> Bits:
    """The shingles that two of the sets (node, tokens) have, a row for each node."""
    tokens = sets.select(F.explode("tokens").alias("token"))
    twice = _in_passes(tokens, lambda mine: mine.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token"))
    found = Bits(sets.sparkSession, twice)
    drop_table(sets.sparkSession, twice)
    return found


def _hopeful(sets: DataFrame, in_two: Bits, num: int, den: int) -> DataFrame:
    """The rows of (node, tokens) that the union of all other sets does not rule out: num/den of their shingles are in another set too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            lists = batch.column(1)
            held = np.concatenate([[0], np.cumsum(in_two.has(lists.values.to_numpy()))])
            ends = lists.offsets.to_numpy()
            common, size = held[ends[1:]] - held[ends[:-1]], np.diff(ends)
            yield batch.filter(pa.array(den * common >= num * size))

    return sets.select("node", "tokens").mapInArrow(settled(emit), "node long, tokens array<long>")


def _tiles(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root, kind, tile, tiles, asks): where the nodes of the rows (sig, node, root) lie, whose signatures several components share.

    Roots that share signatures make a clump, and the root with most nodes is its main one. A clump's nodes lie in tiles of a bounded
    number of members; tiles says how many its clump has. Every node but the main root's asks.
    """
    met = left.groupBy("sig").agg(F.min("root").alias("least"))
    clumps = connected_components(left.join(met, "sig").where("root > least").select(F.col("root").alias("a"), F.col("least").alias("b")))
    nodes = left.groupBy("node").agg(F.first("root").alias("root"))
    nodes = nodes.join(clumps.select(F.col("node").alias("root"), F.col("root").alias("clump")), "root", "left").withColumn("clump", F.coalesce("clump", "root"))
    members = materialize(nodes.join(sets.select("node", F.size("tokens").alias("n")), "node").withColumn("kind", F.col("clump")), "members")
    main = members.groupBy("clump", "root").count().groupBy("clump").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    sizes = members.groupBy("kind").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_MEMBERS), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("tiles"))
    placed = members.join(main, "clump").join(sizes, "kind").select("node", "root", "kind", F.pmod(F.xxhash64("node"), "tiles").alias("tile"), "tiles", (F.col("root") != F.col("main")).alias("asks"))
    placed = materialize(placed, "tiles")
    for table in (clumps, members):
        drop_table(left.sparkSession, table)
    return placed


def _routes(left: DataFrame, placed: DataFrame, pilot: bool) -> DataFrame:
    """(q_node, q_root, kind, tile): the tiles that a node which asks goes to.

    A pilot sends it to one tile of its clump, if there are several. Otherwise it goes to each tile that holds one of its signatures
    under another root; those whose signatures lie in as many tiles as the clump has, counted one by one, go to all of them at
    once, so a frequent signature never meets its tiles node by node.
    """
    asking = placed.where("asks").select(F.col("node").alias("q_node"), F.col("root").alias("q_root"), "kind", "tiles")
    if pilot:
        return materialize(asking.where("tiles > 1").select("q_node", "q_root", "kind", F.lit(0).cast("long").alias("tile")), "routes")
    by_sig = materialize(left.select("sig", "node").join(placed.where("tiles > 1"), "node"), "crowded")
    held = by_sig.groupBy("sig", "kind", "tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    own = by_sig.where("asks").select("sig", F.col("node").alias("q_node"), F.col("root").alias("q_root"), "tiles")
    reach = own.join(held.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sig").groupBy("q_node").agg(F.sum("n").alias("n"), F.first("tiles").alias("tiles"))
    few = reach.where("n < tiles").select("q_node")
    everywhere = asking.join(few, "q_node", "left_anti").select("q_node", "q_root", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    some = own.join(few, "q_node", "left_semi").join(held, "sig").where("lo <> q_root OR hi <> q_root").select("q_node", "q_root", "kind", "tile").distinct()
    routes = materialize(everywhere.union(some), "routes")
    drop_table(left.sparkSession, by_sig)
    return routes


def _links_across(left: DataFrame, placed: DataFrame, sets: DataFrame, num: int, den: int, pilot: bool = False) -> DataFrame:
    """(a, b): links that join the components (root) of the rows (sig, node, root), which lie in tiles; a tile with many askers is opened in as many parts."""
    routes = _routes(left, placed, pilot)
    loads = routes.groupBy("kind", "tile").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("parts"))
    queries = routes.join(loads, ["kind", "tile"]).withColumn("part", F.pmod(F.xxhash64("q_node"), "parts"))
    queries = large(queries).join(sets.select(F.col("node").alias("q_node"), F.col("tokens").alias("q_tokens")), "q_node")
    queries = queries.select(F.col("kind").alias("q_kind"), F.col("tile").alias("q_tile"), F.col("part").alias("q_part"), "q_node", "q_root", "q_tokens")
    opened = placed.join(loads, ["kind", "tile"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    opened = large(opened).join(sets.select("node", "tokens"), "node").select("kind", "tile", "part", "node", "root", "tokens")
    links = opened.groupBy("kind", "tile", "part").cogroup(queries.groupBy("q_kind", "q_tile", "q_part")).applyInPandas(_other_links(num, den), "a long, b long")
    links = materialize(links, "links")
    drop_table(left.sparkSession, routes)
    return links


def ngram_components(docs: DataFrame, width: int = 4, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected components of the documents whose shingle sets have Jaccard similarity num/den or more.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set is its distinct shingles of width words, or its whole
    sequence if it has fewer. Returns id_col, n_shingles (set size) and component_id: the least id reachable by links, itself
    included; one row for each row of docs. Null and empty texts have no set and are their own component; equal texts and
    repeated rows are one component; other columns play no part. num/den must be above 1/2.

    Exact but for 64-bit hash collisions. Shuffles: part signatures as three numbers, a quarter of them at a time, then only rows
    of nodes that share a signature with another node. No broadcast but a filter of fixed size.
    """
    spark, (num, den) = docs.sparkSession, similarity
    if not den < 2 * num <= 2 * den:
        raise ValueError("similarity must be above 1/2 and at most 1")
    texts = docs.select(F.xxhash64(id_col).alias("id_hash"), F.col(text_col).alias("text"))
    signed = materialize(document_nodes(docs, width, similarity, id_col, text_col), "nodes")
    shared = _shared_signatures(signed)
    rows = materialize(signed.drop("sigs", "filed"), "nodes")  # the signatures are most of it
    drop_table(spark, signed)

    first_rows = Bits(spark, rows.where("node IS NOT NULL").groupBy("node").agg(F.min_by("key", F.struct("doc_id", "key")).alias("key")).select("key"))
    in_shared = Bits(spark, shared.select("node"))
    near = materialize(_set_rows(texts, width, first_rows, in_shared).dropDuplicates(["node"]), "near")
    first_rows.drop()
    in_shared.drop()
    in_two = _in_two(near)
    sets = materialize(_hopeful(near, in_two, num, den), "sets")
    in_two.drop()
    shared_left = shared.join(sets.select("node"), "node", "left_semi").withColumn("root", F.col("node"))
    left = materialize(_mixed(shared_left).select("sig", "node"), "shared")
    for table in (near, shared):
        drop_table(spark, table)

    least = left.groupBy("sig").agg(F.min("node").alias("lo"))
    centers = materialize(left.join(least, "sig").groupBy("node").agg(F.min("lo").alias("center")), "centers")
    sized = centers.join(sets.select("node", F.size("tokens").alias("n")), "node")
    sizes = sized.groupBy("center").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("chunks"))
    placed = centers.join(sizes, "center").select("node", "center", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"))
    with_center = placed.union(placed.select(F.col("center").alias("node"), "center", "chunk").distinct())
    grouped = large(with_center).join(sets, "node")
    edges = materialize(grouped.groupBy("center", "chunk").applyInPandas(_own_links(num, den), "a long, b long"), "links")
    roots = connected_components(edges)
    drop_table(spark, edges)
    drop_table(spark, centers)

    # What is left: signatures that nodes of several components share. In a clump of several tiles, the components that one tile
    # links are joined first, or nearly all of its nodes would ask all tiles.
    placed, pilot = None, True
    while True:
        if placed is None:
            rooted = left.select("sig", "node").join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
            before, left = left, materialize(_mixed(rooted), "left")
            drop_table(spark, before)
            placed = _tiles(left, sets)
        pilot = pilot and bool(placed.where("tiles > 1").limit(1).count())
        more = _links_across(left, placed, sets, num, den, pilot)
        if more.limit(1).count():
            before, roots = roots, connected_components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            drop_table(spark, before)
        drop_table(spark, more)
        if not pilot:
            break
        drop_table(spark, placed)
        placed, pilot = None, False
    for table in (left, sets, placed):
        drop_table(spark, table)

    first = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = first.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    components = named.join(least, "root").select("node", "component_id")
    joined = rows.join(components, "node", "left")
    return joined.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


#: The same by joining shingles and walking all links: for tables whose common shingles are few.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.y, r.root FROM reach r JOIN ends e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT r.doc_id, COALESCE(max(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
"""


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of the rows of docs linked by ngram_components, the one of least id (null ids last, then hash of the text).

    Rows are told apart by id and text: null and repeated ids have components of their own; of equal rows one stays.
    """
    key = "tidemark_row_key"
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return one_of_each(keyed, ngram_components(keyed, id_col=key, text_col=text_col, **options), key).drop(key)


def one_of_each(docs: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the least of its component; of repeated rows of that id, one stays.

    Ids must tell rows apart, as row_key does; see without_near_copies.
    """
    kept = components.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("tidemark_kept_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("tidemark_kept_id")), "left_semi").dropDuplicates([id_col])
