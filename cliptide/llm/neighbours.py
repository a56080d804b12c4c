"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Vectors are dealt to shards by their length, in bands of a factor of two, and by a hash of their id.
Each shard's task builds a hierarchical graph and stores it as flat neighbour arrays, one row per
shard. Queries come in blocks; every block meets every shard once, and each query's best of all
shards are merged. Within a shard a coordinate is added that gives all vectors the same length, so
that the largest inner product is the smallest distance. Vectors closer than ``NEAR`` to another are
one node of the graph with it; all members of the nodes found are ranked by their exact scores, and
where a member of a further node could be among the best, so are all that could be.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.operators.exact import settled, small_table

SHARD_ROWS = 4096
BLOCK_ROWS = 512
LINKS = 12
EF_BUILD = 64
EF_SEARCH = 64
#: Vectors within this distance of a node's first one, as a share of the longest, are its members.
NEAR = 0.01

INDEX = "dim int, band int, shard int, ids binary, vector_of binary, vectors binary, members binary, entry int, levels int, row_starts binary, level_nodes binary, links binary, widths binary"


@dataclass
class Graph:
    """Nodes as float rows, and per level the neighbour rows of its nodes (-1: none)."""

    points: np.ndarray
    entry: int
    rows: list[np.ndarray]
    links: list[np.ndarray]

    def nearest(self, query: np.ndarray, size: int, seen: np.ndarray, stamp: int) -> list[tuple[float, int]]:
        """(distance, node) of about the ``size`` nearest nodes, nearest first."""
        first = (-float(self.points[self.entry] @ query), self.entry)
        at = [first]
        for level in range(len(self.links) - 1, 0, -1):
            at = self._descend(query, at[0], level)
        if at != [first]:
            at.append(first)  # from which every node can be reached
        return self.around(query, at, size, 0, seen, stamp)

    def _descend(self, query, best, level):
        while True:
            near = self.links[level][self.rows[level][best[1]]]
            near = near[near >= 0]
            if not len(near):
                return [best]
            away = -(self.points[near] @ query)
            i = int(away.argmin())
            if away[i] >= best[0]:
                return [best]
            best = (float(away[i]), int(near[i]))

    def around(self, query, start, size, level, seen, stamp):
        """Best-first search on one level."""
        points, links, rows = self.points, self.links[level], self.rows[level]
        open_, found = list(start), [(-d, n) for d, n in start]
        heapq.heapify(open_)
        heapq.heapify(found)
        for _, node in start:
            seen[node] = stamp
        while open_:
            away, node = heapq.heappop(open_)
            if len(found) >= size and away > -found[0][0]:
                break
            near = links[rows[node]]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            for d, n in zip((-(points[near] @ query)).tolist(), near.tolist()):
                if len(found) < size:
                    heapq.heappush(found, (-d, n))
                    heapq.heappush(open_, (d, n))
                elif d < -found[0][0]:
                    heapq.heapreplace(found, (-d, n))
                    heapq.heappush(open_, (d, n))
        return sorted((-d, n) for d, n in found)


def _spread(points: np.ndarray, away: np.ndarray, nodes: np.ndarray, limit: int) -> np.ndarray:
    """Of ``nodes`` by rising distance, those nearer to the centre than to any chosen before; then the nearest rest."""
    if len(nodes) <= limit:
        return nodes
    own = points[nodes]
    between = -(own @ own.T)
    chosen: list[int] = []
    nearest = np.full(len(nodes), np.inf)
    for i in range(len(nodes)):
        if away[i] < nearest[i]:
            chosen.append(i)
            if len(chosen) == limit:
                break
            np.minimum(nearest, between[i], out=nearest)
    if len(chosen) < limit:
        taken = set(chosen)
        chosen += [i for i in range(len(nodes)) if i not in taken][: limit - len(chosen)]
    return nodes[np.array(chosen)]


def build(points: np.ndarray, seed: int = 0) -> Graph:
    """Insert the points one by one, in order."""
    n, rng = len(points), np.random.default_rng(seed)
    top = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
    levels = int(top.max()) + 1
    rows = [np.cumsum(top >= level) - 1 for level in range(levels)]
    most = [2 * LINKS if level == 0 else LINKS for level in range(levels)]
    links = [np.full((int((top >= level).sum()), most[level] + LINKS), -1, np.int32) for level in range(levels)]
    held = [np.zeros(len(x), np.int32) for x in links]
    seen = np.zeros(n, np.int64)
    graph = Graph(points, 0, rows, links)
    height, stamp = int(top[0]), 0

    def put(level, node, nodes):
        row = rows[level][node]
        links[level][row] = -1
        links[level][row, : len(nodes)] = nodes
        held[level][row] = len(nodes)

    for node in range(1, n):
        query = points[node]
        at = [(-float(points[graph.entry] @ query), graph.entry)]
        for level in range(height, int(top[node]), -1):
            at = graph._descend(query, at[0], level)
        for level in range(min(height, int(top[node])), -1, -1):
            stamp += 1
            at = graph.around(query, at, EF_BUILD, level, seen, stamp)
            away, near = np.array([d for d, _ in at]), np.array([m for _, m in at], np.int64)
            chosen = _spread(points, away, near, LINKS)
            put(level, node, chosen)
            for other in chosen.tolist():
                row = rows[level][other]
                if held[level][row] < links[level].shape[1]:
                    links[level][row, held[level][row]] = node
                    held[level][row] += 1
                    continue
                around = np.append(links[level][row], node).astype(np.int64)
                far = -(points[around] @ points[other])
                order = np.argsort(far, kind="stable")
                put(level, other, _spread(points, far[order], around[order], most[level]))
        if top[node] > height:
            height, graph.entry = int(top[node]), node
    _join_up(graph)
    return graph


def _join_up(graph: Graph) -> None:
    """Give each node that cannot be reached from the entry a link from the nearest one that can."""
    reached = np.zeros(len(graph.points), bool)

    def spread_from(nodes):
        while len(nodes):
            reached[nodes] = True
            near = np.unique(graph.links[0][nodes])
            near = near[near >= 0]
            nodes = near[~reached[near]]

    spread_from(np.array([graph.entry]))
    for node in range(len(reached)):
        if reached[node]:
            continue
        known = np.flatnonzero(reached)
        to = known[int((graph.points[known] @ graph.points[node]).argmax())]
        links = graph.links[0]
        held = int((links[to] >= 0).sum())
        if held == links.shape[1]:
            links = graph.links[0] = np.pad(links, ((0, 0), (0, LINKS)), constant_values=-1)
        links[to, held] = node
        spread_from(np.array([node]))


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part."""
    values = F.col(embedding).cast("array<double>")
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & sound & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def length_band(embedding: str) -> Column:
    """Base-2 logarithm of the length, rounded; lengths near 1 share a band."""
    largest = F.array_max(F.transform(embedding, lambda x: F.abs(x)))
    squares = F.aggregate(embedding, F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))
    return F.floor(F.log2(largest) + F.log2(squares) / 2 + 0.5).cast("int")


def _grouped(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows by group, its first row in front; the others are within NEAR of it."""
    group = np.full(len(points), -1)
    firsts: list[int] = []
    for i in range(len(points)):
        if group[i] < 0:
            free = np.flatnonzero(group < 0)
            close = free[points[free] @ points[i] >= 1 - NEAR**2 / 2]
            group[close] = len(firsts)
            group[i] = len(firsts)
            firsts.append(i)
    others = np.ones(len(points), bool)
    others[firsts] = False
    order = np.lexsort((others, group))
    return order, np.searchsorted(group[order], np.arange(len(firsts) + 1))


def _index_shard(pdf):
    import pandas as pd

    pdf = pdf.sort_values("vec_id", kind="stable")
    vectors, vector_of = np.unique(np.array(pdf.embedding.tolist(), np.float64), axis=0, return_inverse=True)
    mixed = np.random.default_rng(1).permutation(len(vectors))  # np.unique has sorted them
    order, starts = _grouped(level_lengths(vectors[mixed]))
    order = mixed[order]
    place = np.empty(len(vectors), np.int64)
    place[order] = np.arange(len(vectors))
    vectors, vector_of = vectors[order], place[vector_of.ravel()]
    graph = build(level_lengths(vectors)[starts[:-1]])
    return pd.DataFrame([{
        "dim": vectors.shape[1], "band": int(pdf.band.iloc[0]), "shard": int(pdf.shard.iloc[0]),
        "ids": pdf.vec_id.to_numpy(np.int64).tobytes(), "vector_of": vector_of.astype(np.int64).tobytes(), "vectors": vectors.tobytes(),
        "members": starts.astype(np.int64).tobytes(), "entry": graph.entry, "levels": len(graph.links),
        "row_starts": np.cumsum([0] + [len(x) for x in graph.links]).astype(np.int64).tobytes(),
        "level_nodes": b"".join(r.astype(np.int32).tobytes() for r in graph.rows),
        "links": b"".join(x.tobytes() for x in graph.links),
        "widths": np.array([x.shape[1] for x in graph.links], np.int64).tobytes(),
    }])


def level_lengths(vectors: np.ndarray) -> np.ndarray:
    """The vectors with a coordinate added that makes them equally long, scaled to length 1."""
    scaled = vectors / np.abs(vectors).max()
    squares = (scaled**2).sum(axis=1)
    rest = np.sqrt(np.maximum(squares.max() - squares, 0))
    return np.column_stack([scaled, rest]) / np.sqrt(squares.max())


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard with its vectors and graph, written below the shared folder."""
    rows = valid(vectors, vec_id, embedding).withColumn("band", length_band("embedding"))
    shards = rows.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).alias("shards"))
    placed = rows.join(small_table(shards), ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int")).drop("shards")
    return settled(placed.groupBy("dim", "band", "shard").applyInPandas(_index_shard, INDEX), "graphs")


def _open(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The graph, the distinct vectors, where each node's begin, ids and the vector of each."""
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    members = np.frombuffer(row["members"], np.int64)
    starts, widths = np.frombuffer(row["row_starts"], np.int64), np.frombuffer(row["widths"], np.int64)
    flat, rows = np.frombuffer(row["links"], np.int32), np.frombuffer(row["level_nodes"], np.int32).reshape(len(widths), -1)
    links, at = [], 0
    for level, width in enumerate(widths):
        size = (starts[level + 1] - starts[level]) * width
        links.append(flat[at : at + size].reshape(-1, width))
        at += size
    graph = Graph(level_lengths(vectors)[members[:-1]], row["entry"], list(rows), links)
    return graph, vectors, members, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vector_of"], np.int64)


def _search_shard(row: dict, k: int, ef: int):
    """(query_id, vec_id, score) of a block's best in one shard."""
    graph, vectors, members, ids, vector_of = _open(row)
    order = np.argsort(vector_of, kind="stable")  # ids ascend within a vector
    starts = np.searchsorted(vector_of[order], np.arange(len(vectors) + 1))
    firsts = ids[order[starts[:-1]]]
    seen = np.zeros(len(graph.points), np.int64)
    points = level_lengths(vectors)
    radius = np.sqrt(((points - np.repeat(graph.points, np.diff(members), axis=0)) ** 2).sum(axis=1).max())
    queries = np.frombuffer(row["q_vectors"], np.float64).reshape(-1, row["dim"])
    for stamp, (query_id, query) in enumerate(zip(np.frombuffer(row["q_ids"], np.int64), queries), 1):
        flat = np.append(query / np.abs(query).max(), 0)
        found = graph.nearest(flat, ef, seen, stamp)
        near = np.concatenate([np.arange(members[n], members[n + 1]) for _, n in found])
        if radius and len(near) > k:
            least = np.partition(points[near] @ flat, -k - 1)[-k - 1] - radius * np.linalg.norm(flat)
            if -found[-1][0] >= least:  # members of further nodes may be among the best: all that can be are ranked
                near = np.flatnonzero(np.repeat(graph.points @ flat >= least, np.diff(members)))
        scores = (vectors[near] * query).sum(axis=1)  # row by row: equal vectors have equal scores
        best = []
        for i in np.lexsort((firsts[near], -scores)):
            if len(best) >= k and scores[i] < best[k - 1][2]:
                break
            same = ids[order[starts[near[i]] : starts[near[i] + 1]]]
            best += [(int(query_id), int(m), float(scores[i])) for m in same[same != query_id][:k]]
        yield from sorted(best, key=lambda r: (-r[2], r[1]))[:k]


def search(graphs: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, nearest first, from rank 1.

    Scores are inner products of the original vectors in double precision; ties go to the smaller
    id. A query does not find its own id. Vectors that are null, zero, or hold a null, NaN or
    infinity neither ask nor are found; nor does a vector meet one of another length. Rows that
    repeat an id and vector are found once each. Empty tables give no rows; other columns are
    ignored.
    """
    import pandas as pd

    asked = valid(queries, vec_id, embedding)
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))

    def pack(pdf):
        pdf = pdf.sort_values("vec_id", kind="stable")
        return pd.DataFrame([{
            "dim": int(pdf.dim.iloc[0]), "block": int(pdf.block.iloc[0]), "q_ids": pdf.vec_id.to_numpy(np.int64).tobytes(),
            "q_vectors": np.array(pdf.embedding.tolist(), np.float64).tobytes(),
        }])

    packed = asked.dropDuplicates(["vec_id", "dim"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInPandas(
        pack, "dim int, block int, q_ids binary, q_vectors binary"
    )
    every = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(pdf):
        found = [r for row in pdf.to_dict("records") for r in _search_shard(row, k, max(ef, k + 1))]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    met = every.join(packed, ["dim", "block"]).groupBy("dim", "band", "shard", "block").applyInPandas(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return met.select("query_id", place, "vec_id", "score").filter(F.col("rank") <= k)
