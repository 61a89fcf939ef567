"""Approximate nearest neighbours by largest inner product.

Rows are dealt to shards by a hash of their id, shards to tasks by their number. Each shard gets
a hierarchical navigable small-world graph, stored as flat arrays of neighbours, one block
of rows per level. Blocks of queries meet every shard, and the shards' results are merged
and ranked. As a query meets all shards, their number is what a search costs: shards have at
least ``SHARD_ROWS`` rows, and more on larger tables, as many as keep all cores busy, up to
``SHARD_BYTES`` of index, which a task must hold. Inner product becomes a distance by one more
component, which gives all vectors of a shard the same length. Equal vectors of a shard are
one node with a list of ids, so thousands of copies don't fill each other's neighbour lists. How wide a shard is
searched follows from its own recall, measured on a sample beside brute force when it is built.

Graphs are searched in single precision on scaled vectors. Scores are computed in double
precision on the vectors as given, always summed from the first component to the last, so that
equal vectors tie wherever they lie.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components
take no part, nor do rows without an id; vectors of different lengths do not meet; vectors of any
length take part, though each shard holds fewer of them; equal scores are ties that the smaller id
wins; rows that share an id count as one item, with its best score; an empty table gives an empty
result; columns besides the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.common import bounded, durable, pick

SHARD_ROWS, SHARD_BYTES = 32_768, 96 << 20
QUERY_BLOCK = 2048
LINKS = 16
EF_BUILD = 80
EF_SEARCH = 200
#: A shard's searches are as wide as it takes to find so much of what brute force finds among its rows, for so many of
#: its own rows as queries and so many nearest ones.
LEAST_RECALL, SAMPLE, SAMPLE_NEAREST = 0.97, 100, 20


class Graph:
    """A small-world graph over unit-scaled rows of ``vectors`` (equal lengths)."""

    def __init__(self, vectors: np.ndarray, counts: np.ndarray, links: np.ndarray):
        """``counts``: nodes on each level (nodes 0 to count - 1); ``links``: the levels' neighbour
        arrays, one after another, 2 x LINKS wide on level 0 and LINKS wide above, -1 for none."""
        self.vectors, self.counts, self.links = vectors, counts, links
        self.levels, at = [], 0
        for level, n in enumerate(counts):
            width = LINKS if level else 2 * LINKS
            self.levels.append(links[at : at + n * width].reshape(n, width))
            at += n * width
        self.met = np.zeros(len(vectors), np.int32)
        self.turn = 0

    def search_level(self, query: np.ndarray, entries: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """Up to ``ef`` of the most similar nodes that a best-first walk finds, most similar first."""
        self.turn += 1
        met, turn, near, vectors = self.met, self.turn, self.levels[level], self.vectors
        met[[i for _, i in entries]] = turn
        work = [(-s, i) for s, i in entries]
        best = list(entries)  # a heap, least similar first
        heapify(work)
        heapify(best)
        while work:
            s, i = heappop(work)
            if len(best) >= ef and -s < best[0][0]:
                break
            row = near[i]
            fresh = row[(row >= 0) & (met[row] != turn)]
            if not len(fresh):
                continue
            met[fresh] = turn
            for j, sim in zip(fresh.tolist(), (vectors[fresh] @ query).tolist()):
                if len(best) < ef:
                    heappush(best, (sim, j))
                    heappush(work, (-sim, j))
                elif sim > best[0][0]:
                    heapreplace(best, (sim, j))
                    heappush(work, (-sim, j))
        return sorted(best, reverse=True)

    def search(self, query: np.ndarray, ef: int) -> list[int]:
        found = [(float(self.vectors[0] @ query), 0)]
        for level in range(len(self.counts) - 1, 0, -1):
            found = self.search_level(query, found[:1], 1, level)
        return [i for _, i in self.search_level(query, found, ef, 0)]


def _varied(vectors: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """The most similar nodes of which none is closer to one chosen before than to the centre;
    if there is room, the nearest of the others."""
    if len(found) <= most:
        return [i for _, i in found]
    nodes = np.array([i for _, i in found])
    among = vectors[nodes] @ vectors[nodes].T
    chosen, others = [], []
    closest = np.full(len(nodes), -np.inf, among.dtype)
    for k, (s, _) in enumerate(found):
        if closest[k] <= s:
            chosen.append(k)
            if len(chosen) == most:
                break
            np.maximum(closest, among[k], out=closest)
        else:
            others.append(k)
    return nodes[(chosen + others)[:most]].tolist()


def build_graph(vectors: np.ndarray, seed: int = 1) -> Graph:
    """Nodes must be in the order of falling level; ``level_counts`` says how many each has."""
    n = len(vectors)
    counts = level_counts(n)
    graph = Graph(vectors, counts, np.full(int(counts[0]) * 2 * LINKS + int(counts[1:].sum()) * LINKS, -1, np.int32))
    top_of = np.zeros(n, np.int32)
    for level, count in enumerate(counts):
        top_of[:count] = level
    for i in range(1, n):
        query = vectors[i]
        found = [(float(vectors[0] @ query), 0)]
        for level in range(len(counts) - 1, -1, -1):
            if level > top_of[i]:
                found = graph.search_level(query, found[:1], 1, level)
                continue
            found = graph.search_level(query, found, EF_BUILD, level)
            rows = graph.levels[level]
            width = rows.shape[1]
            mine = _varied(vectors, found, LINKS)
            rows[i, : len(mine)] = mine
            for j in mine:
                row = rows[j]
                free = int((row >= 0).sum())
                if free < width:
                    row[free] = i
                else:
                    others = [*row.tolist(), i]
                    near = sorted(zip((vectors[others] @ vectors[j]).tolist(), others), reverse=True)
                    row[:] = -1
                    kept = _varied(vectors, near, width)
                    row[: len(kept)] = kept
    return graph


def level_counts(n: int) -> np.ndarray:
    """Nodes by level: each level has a LINKS-th of the nodes of the level below."""
    counts = [n]
    while counts[-1] > 2 * LINKS:
        counts.append(counts[-1] // LINKS)
    return np.array(counts, np.int64)


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to at most 1 by one number, and their lengths."""
    small = vectors / np.abs(vectors).max()
    return small, np.sqrt((small**2).sum(axis=1))


def build_shard(ids: np.ndarray, vectors: np.ndarray) -> dict[str, bytes]:
    """A shard's index as flat arrays: distinct vectors, the ids of each, and the graph."""
    distinct, inverse = np.unique(np.ascontiguousarray(vectors, np.float64), axis=0, return_inverse=True)
    order = np.random.default_rng(len(distinct)).permutation(len(distinct))  # so that levels are random
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    distinct, node = distinct[order], place[inverse.ravel()]
    pairs = np.unique(np.column_stack([node, ids.astype(np.int64)]), axis=0)  # repeated rows once, by node and id
    small, length = _scaled(distinct)
    more = np.sqrt(np.maximum(length.max() ** 2 - length**2, 0))
    graph = build_graph((np.column_stack([small, more]) / length.max()).astype(np.float32))
    return {
        "vectors": distinct.tobytes(),
        "first": np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)).astype(np.int64).tobytes(),
        "ids": pairs[:, 1].tobytes(),
        "counts": graph.counts.tobytes(),
        "links": graph.links.tobytes(),
        "width": np.array([width_for(Graph(small.astype(np.float32), graph.counts, graph.links))]).tobytes(),
    }


def width_for(graph: Graph) -> int:
    """How wide searches must be: doubled until a sample's recall beside brute force suffices. So it follows from
    each shard's size and vectors."""
    n, width = len(graph.vectors), EF_SEARCH
    if n <= width:
        return width
    sample = np.unique(np.linspace(0, n - 1, SAMPLE).astype(np.int64))
    scores = graph.vectors @ graph.vectors[sample].T
    near = [{*np.argpartition(-scores[:, j], SAMPLE_NEAREST)[:SAMPLE_NEAREST].tolist()} for j in range(len(sample))]
    while width < n:
        met = sum(len({*graph.search(graph.vectors[i], width)[:SAMPLE_NEAREST]} & want) for i, want in zip(sample.tolist(), near))
        if met >= LEAST_RECALL * SAMPLE_NEAREST * len(sample):
            break
        width *= 2
    return width


class Shard:
    def __init__(self, dim: int, vectors: bytes, first: bytes, ids: bytes, counts: bytes, links: bytes, width: bytes):
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.first, self.ids = np.frombuffer(first, np.int64), np.frombuffer(ids, np.int64)
        self.width = int(np.frombuffer(width, np.int64)[0])
        self.graph = Graph(_scaled(self.vectors)[0].astype(np.float32), np.frombuffer(counts, np.int64), np.frombuffer(links, np.int32))

    def nearest(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` nearest found, nearest first, ties to the smaller id."""
        small = (query / np.abs(query).max()).astype(np.float32)
        ef = max(self.width, 2 * k)
        while True:
            nodes = np.array(self.graph.search(small, ef))
            found = self._ranked(nodes, own, query, k)
            if len(found[0]) == k or len(nodes) < ef:
                break
            ef *= 4  # a few ids have all vectors that the walk met
        if len(found[0]) < k and len(nodes) < len(self.vectors):  # and these are all that it can reach
            found = self._ranked(np.arange(len(self.vectors)), own, query, k)
        return found

    def _ranked(self, nodes: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        exact = np.cumsum(self.vectors[nodes] * query, axis=1)[:, -1]
        ids, scores = [], []
        for node, score in zip(nodes, exact):
            mine = self.ids[self.first[node] : self.first[node + 1]][: k + 1]  # distinct, so no more can be among k
            ids.append(mine[mine != own])
            scores.append(np.full(len(ids[-1]), score))
        flat, value = np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((flat, -value))
        order = order[np.sort(np.unique(flat[order], return_index=True)[1])[:k]]  # an id counts once, where it is best
        return flat[order], value[order]


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(columns: list[pa.Array], dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    return np.concatenate(flat).astype(np.float64).reshape(-1, dim)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with the same key, of rows sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in key])
        borders = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, end in zip(borders, borders[1:]):
            if start == end:
                continue
            if held and tuple(keys[start]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = tuple(keys[start])
    if held:
        yield pa.Table.from_batches(held)


#: Rows of a task that searches: the shard's index (``block`` -1), then blocks of queries.
INDEX = "dim int, shard int, block int, vectors binary, first binary, ids binary, counts binary, links binary, width binary"
BLOCKS = "dim int, block int, q_ids binary, q_vectors binary"
FOUND = "query_id long, vec_id long, score double"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches, ["dim", "shard"]):
        dim, shard = group["dim"][0].as_py(), group["shard"][0].as_py()
        made = build_shard(group["id"].to_numpy(), _matrix(group["vector"].chunks, dim))
        row = {"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "block": pa.array([-1], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in made.items()}
        yield pa.RecordBatch.from_pydict(row)


def _block(group: pa.Table) -> pa.Table:
    dim, block = group["dim"][0].as_py(), group["block"][0].as_py()
    ids, vectors = group["id"].to_numpy(), _matrix(group["vector"].chunks, dim)
    key = {"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32())}
    return pa.table(key | {"q_ids": [ids.tobytes()], "q_vectors": [vectors.tobytes()]})


def _search(k: int):
    def run(batches):
        shard, dim = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] < 0:
                    shard, dim = Shard(row["dim"], *(row[c] for c in ("vectors", "first", "ids", "counts", "links", "width"))), row["dim"]
                if row["block"] < 0 or row["dim"] != dim:
                    continue
                ids = np.frombuffer(row["q_ids"], np.int64)
                vectors = np.frombuffer(row["q_vectors"], np.float64).reshape(-1, dim)
                found = [shard.nearest(int(own), q, k) for own, q in zip(ids, vectors)]
                columns = [np.repeat(ids, [len(f[0]) for f in found]), *(np.concatenate([f[j] for f in found]) for j in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def shards_for(rows: int, dim: int, cores: int) -> int:
    """How many shards: as few as memory allows, but one for each core if that leaves them large."""
    most = max(1, SHARD_BYTES // (8 * dim + 8 * LINKS + 24))
    return max(-(-rows // most), min(cores, -(-rows // SHARD_ROWS)), 1)


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query, where
    ``is_query`` is a condition on the column ``id``."""
    valid = (
        pick(rows, id_col, vector_col)
        .toDF("id", "vector")
        .where(F.col("id").isNotNull() & usable(F.col("vector")))
        .select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        .withColumn("dim", F.size("vector"))
    )
    n, queries, dim = valid.select(F.count("*"), F.count_if(is_query), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = shards_for(n, dim, rows.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-queries // QUERY_BLOCK))
    index = durable(
        valid.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        .repartitionById(shards, "shard")
        .sortWithinPartitions("dim")
        .mapInArrow(_build, INDEX)
    )
    asked = (
        valid.where(is_query)
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
        .groupBy("dim", "block")
        .applyInArrow(_block, BLOCKS)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    bounded(rows.sparkSession)
    met = (
        index.unionByName(asked, allowMissingColumns=True)
        .repartitionById(shards, "shard")
        .sortWithinPartitions("dim", "block")
        .mapInArrow(_search(k), FOUND)
    )
    # an id met in several rows counts once, with its best score
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
