"""Approximate nearest neighbours on sharded, robust-pruned graphs.

Vectors are dealt to shards by hash; each shard is one directed graph over its different vectors. Vectors are
inserted in blocks: a greedy beam search from the entry points (the vector nearest to the mean, then always the one
farthest from those chosen, so that tight clusters have one of their own) proposes neighbours, and pruning keeps, nearest first, those that no kept one is ``1 / alpha`` times nearer to, so that edges point
in different directions. Reverse edges are added and pruned alike; every vector is inserted twice, the
second time over the finished graph. Vectors that no path from an entry point reaches become entry points. A query runs a beam search in every shard; the best of all shards, by exact distance
of the original vectors in double precision, are its neighbours.

Searches of a block run side by side in NumPy. A shard has ``shard_rows`` vectors on average and queries come in blocks
of ``query_rows``, so a task's memory is bounded by both and not by the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.session import cut

SHARD_ROWS = 4_096
QUERY_ROWS = 8_192
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
BLOCK = 256
ENTRIES = 64  # per shard, besides vectors that would be unreachable
STARTS = 16  # of them, the nearest ones that a search starts from


def usable(vector: str) -> Column:
    """Not null or empty, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _far(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.einsum("...d,...d->...", x - points, x - points)


class Graph:
    """Edges of one shard; -1 fills the rows of ``edges``."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, entries: np.ndarray | None = None):
        self.points = points
        self.edges = np.full((len(points), DEGREE), -1, np.int32) if edges is None else edges
        self.entries = self._spread() if entries is None else entries

    def _spread(self) -> np.ndarray:
        """The point nearest to the mean, then farthest first; fewer where no further point differs."""
        chosen = [int(_far(self.points, self.points.mean(0)).argmin())]
        nearest = _far(self.points, self.points[chosen[0]])
        while len(chosen) < ENTRIES and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _far(self.points, self.points[chosen[-1]]))
        return np.array(chosen, np.int32)

    def _reached(self, start: np.ndarray, reached: np.ndarray) -> None:
        """Marks what paths from ``start`` lead to."""
        reached[start] = True
        while len(start):
            around = np.unique(self.edges[start])
            start = around[(around >= 0) & ~reached[around]]
            reached[start] = True

    def _reach_all(self) -> None:
        """Unreachable points become entries, one at a time, since one may lead to others."""
        reached = np.zeros(len(self.points), bool)
        self._reached(self.entries, reached)
        more = []
        while not reached.all():
            more.append(int(reached.argmin()))
            self._reached(np.array(more[-1:]), reached)
        self.entries = np.concatenate((self.entries, np.array(more, np.int32)))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: nodes and squared distances, nearest first (-1, inf fill up).

        A query is done when its whole beam has been expanded.
        """
        n, count = len(self.points), len(queries)
        seen = np.zeros((count, n), bool)
        nodes = np.full((count, beam), -1, np.int32)
        far = np.full((count, beam), np.inf)
        fresh = np.zeros((count, beam), bool)
        at = np.arange(count)
        doors = self.points[self.entries]
        # a rough distance picks the doors, the exact one is kept
        rough = (doors * doors).sum(1)[None, :] - 2 * queries @ doors.T
        picked = np.argsort(rough, 1, kind="stable")[:, :min(STARTS, beam)]
        starts = self.entries[picked]
        distance = _far(queries[:, None, :], self.points[starts])
        order = np.argsort(distance, 1, kind="stable")
        wide = starts.shape[1]
        nodes[:, :wide], far[:, :wide], fresh[:, :wide] = np.take_along_axis(starts, order, 1), np.take_along_axis(distance, order, 1), True
        seen[at[:, None], starts] = True
        while len(at):
            first = fresh[at].argmax(1)
            going = fresh[at, first]
            at, first = at[going], first[going]
            if not len(at):
                break
            fresh[at, first] = False
            around = self.edges[nodes[at, first]]
            new = (around >= 0) & ~seen[at[:, None], around]
            row, col = np.nonzero(new)
            seen[at[row], around[row, col]] = True
            distance = np.full(around.shape, np.inf)
            distance[row, col] = _far(queries[at[row]], self.points[around[row, col]])
            both = np.concatenate((far[at], distance), 1)
            order = np.argsort(both, 1, kind="stable")[:, :beam]
            far[at] = np.take_along_axis(both, order, 1)
            nodes[at] = np.take_along_axis(np.concatenate((nodes[at], np.where(new, around, -1)), 1), order, 1)
            fresh[at] = np.take_along_axis(np.concatenate((fresh[at], new), 1), order, 1)
        return nodes, far

    def prune(self, own: int, others: np.ndarray) -> np.ndarray:
        """Of the proposed neighbours those in different directions, ``DEGREE`` at most."""
        others = np.unique(others[(others >= 0) & (others != own)])
        far = _far(self.points[others], self.points[own])
        order = np.argsort(far, kind="stable")
        others, far = others[order], far[order]
        points = self.points[others]
        norms = (points * points).sum(1)
        near = ALPHA * ALPHA * (norms[:, None] + norms[None, :] - 2 * points @ points.T) <= far[None, :]
        kept: list[int] = []
        alive = np.ones(len(others), bool)
        for k in range(len(others)):
            if alive[k]:
                kept.append(others[k])
                if len(kept) == DEGREE:
                    break
                alive &= ~near[k]
        return np.array(kept, np.int32)

    def _link(self, own: int, others: np.ndarray) -> None:
        self.edges[own] = -1
        self.edges[own, :len(others)] = others

    def build(self) -> "Graph":
        """While building, a row holds up to twice ``DEGREE`` edges, so that few reverse edges call for pruning."""
        n = len(self.points)
        self.edges = np.full((n, 2 * DEGREE), -1, np.int32)
        order = np.random.default_rng(n).permutation(n)
        for turn in range(2):
            for low in range(0, n, BLOCK):
                block = order[low:low + BLOCK]
                proposed, _ = self.search(self.points[block], BUILD_BEAM)
                if not turn and low == 0:
                    proposed = np.broadcast_to(block, (len(block), len(block)))  # the first block has no graph yet
                back: dict[int, list[int]] = {}
                for own, found in zip(block, proposed):
                    kept = self.prune(own, np.concatenate((found, self.edges[own])))
                    self._link(own, kept)
                    for other in kept:
                        back.setdefault(int(other), []).append(own)
                for other, more in back.items():
                    wanted = np.union1d(self.edges[other][self.edges[other] >= 0], more)
                    self._link(other, wanted if len(wanted) <= 2 * DEGREE else self.prune(other, wanted))
        full = self.edges
        self.edges = np.full((n, DEGREE), -1, np.int32)
        for own in range(n):
            held = full[own][full[own] >= 0]
            self._link(own, held if len(held) <= DEGREE else self.prune(own, held))
        self._reach_all()
        return self


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(dim, shard, node, id, vector, edges, entries)``: one row per usable key.

    Equal vectors are one node. Its smallest key's row holds the vector, the edges and the shard's entry points; the rows of its further
    keys have null there, so that a vector with very many keys stays many rows. Rows that :func:`usable` refuses or whose key is null take no part; of
    rows with one key the smallest vector counts. Vectors of different length never meet. The number of shards
    follows from the row count, so an empty table gives an empty index. The index is written to the shared folder.
    """
    kind = df.schema[key].dataType.simpleString()
    item = df.schema[vector].dataType.elementType.simpleString()
    rows = cut(df.where(F.col(key).isNotNull() & usable(vector)).groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("vector")))
    first = cut(rows.groupBy("vector").agg(F.min("id").alias("id")))
    shards = max(1, -(-first.count() // shard_rows))
    # equal vectors fall into one shard by the hash of the vector
    dealt = first.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"), "id", "vector")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # the same graph in whatever order the rows came
        dim = table.column("dim")[0].as_py()
        points = table.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
        graph = Graph(points).build()
        return pa.table({
            "dim": table.column("dim"), "shard": table.column("shard"), "node": pa.array(np.arange(len(points), dtype=np.int32)),
            "id": table.column("id"), "vector": table.column("vector"), "edges": pa.array(list(graph.edges), pa.list_(pa.int32())),
            # one row carries the entry points of the shard
            "entries": pa.array([graph.entries if k == 0 else None for k in range(len(points))], pa.list_(pa.int32()))})

    graphs = cut(dealt.groupBy("dim", "shard").applyInArrow(
        build, f"dim int, shard long, node int, id {kind}, vector array<{item}>, edges array<int>, entries array<int>"))
    places = graphs.select("dim", "shard", "node", "vector", F.col("id").alias("least"))
    copies = rows.join(places, "vector").where(F.col("id") != F.col("least")).select("dim", "shard", "node", "id")
    return cut(graphs.unionByName(copies, allowMissingColumns=True))


def search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", beam: int = SEARCH_BEAM,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every usable query, its own key left out.

    Nearest first, ties to the smaller key; all candidates where they are fewer than ``k``. The score is the Euclidean distance
    of the original vectors in double precision, summed component by component.
    """
    kind = queries.schema[key].dataType.simpleString()
    asked = queries.where(F.col(key).isNotNull() & usable(vector)).groupBy(F.col(key).alias("query_id")).agg(F.min(vector).alias("query"))
    asked = cut(asked.select("query_id", "query", F.size("query").alias("dim")))
    blocks = max(1, -(-asked.count() // query_rows))
    graphs = index.where(F.col("edges").isNotNull())
    shards = graphs.select(F.col("dim").alias("shard_dim"), F.col("shard").alias("number")).distinct()
    sent = asked.join(shards, F.col("dim") == F.col("shard_dim")).select(
        "query_id", "query", "dim", F.col("number").alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def find(graphs: pa.Table, asks: pa.Table) -> pa.Table:
        shape = pa.schema([("query_id", asks.schema.field("query_id").type), ("dim", pa.int32()), ("shard", pa.int64()), ("node", pa.int32()),
                           ("least", asks.schema.field("query_id").type), ("score", pa.float64())])
        if not graphs.num_rows or not asks.num_rows:
            return shape.empty_table()
        graphs = graphs.sort_by("node")
        dim, shard = graphs.column("dim")[0].as_py(), graphs.column("shard")[0].as_py()
        read = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
        edges = graphs.column("edges").combine_chunks().flatten().to_numpy().reshape(-1, DEGREE)
        graph = Graph(read(graphs, "vector"), edges, np.array(graphs.column("entries")[0].as_py(), np.int32))
        least, own, points = graphs.column("id").to_pylist(), asks.column("query_id").to_pylist(), read(asks, "query")
        out: list[tuple] = []
        for low in range(0, len(own), BLOCK):
            nodes, _ = graph.search(points[low:low + BLOCK], max(beam, k + 1))
            for q, found in zip(range(low, low + BLOCK), nodes):
                found = found[found >= 0]
                total = np.zeros(len(found))
                for d in range(dim):  # component by component, as one reads the formula
                    total += (graph.points[found, d] - points[q, d]) ** 2
                # k + 1 nodes hold k keys besides the query's own
                best = sorted((s, least[f], int(f)) for s, f in zip(np.sqrt(total), found))[:k + 1]
                out += [(own[q], dim, shard, f, i, float(s)) for s, i, f in best]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((),) * len(shape), shape.types)], schema=shape)

    nodes = held.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInArrow(
        find, f"query_id {kind}, dim int, shard long, node int, least {kind}, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "least")
    nodes = cut(nodes.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= k + 1).drop("k"))
    # of each node the k + 1 smallest keys, limited before the shuffle
    smallest = Window.partitionBy("dim", "shard", "node").orderBy("id")
    members = index.select("dim", "shard", "node", "id").withColumn("k", F.row_number().over(smallest)).where(F.col("k") <= k + 1).drop("k")
    found = nodes.join(members, ["dim", "shard", "node"]).where(F.col("id") != F.col("query_id")).select("query_id", F.col("id").alias("vec_id"), "score")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
