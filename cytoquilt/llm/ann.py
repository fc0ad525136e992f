"""Approximate nearest neighbours: one hierarchical small-world graph per shard (operator 1).

Vectors are dealt to shards by a hash of their id. Each shard builds its own
graph, kept as flat arrays: one of neighbour numbers per level, with a fixed
width. Every query goes to every shard; the shards' best are merged by the exact
distance. Equal vectors of a shard are one node that carries all their ids, so
copies neither crowd the neighbour lists nor get lost.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoquilt.llm.common import quoted
from cytoquilt.session import materialize


class SmallWorld:
    """Hierarchical navigable small-world graph over the rows of ``x`` by squared distance.

    ``links[level]`` holds neighbour numbers, ``width`` (twice that on level 0)
    a node, -1 where there are fewer.
    """

    def __init__(self, x: np.ndarray, width: int = 16, effort: int = 64, seed: int = 1):
        self.x, self.width, self.effort = x, width, effort
        self.norm = np.einsum("ij,ij->i", x, x)
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.floor(-np.log1p(-draw) / np.log(width)).astype(int)
        top = int(self.level.max()) if n else 0
        self.links = [np.full((n, width * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        self.fill = [np.zeros(n, np.int32) for _ in range(top + 1)]
        self.entry = 0
        self._seen, self._mark = np.zeros(n, np.int64), 0
        for i in range(1, n):
            self._insert(i)
            if self.level[i] > self.level[self.entry]:
                self.entry = i

    def stored(self) -> dict[str, bytes | int]:
        """Everything a search needs, as flat arrays."""
        return {
            "points": self.x.tobytes(), "levels": self.level.astype("<i4").tobytes(), "width": self.width, "entry": self.entry,
            "links": b"".join(a.tobytes() for a in self.links),
        }

    @classmethod
    def opened(cls, points: bytes, levels: bytes, width: int, entry: int, links: bytes, dim: int) -> SmallWorld:
        self = cls(np.zeros((0, dim)), width)
        self.x = np.frombuffer(points).reshape(-1, dim)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.level, self.entry = np.frombuffer(levels, "<i4"), entry
        flat, n, at, self.links = np.frombuffer(links, np.int32), len(self.x), 0, []
        for k in range(int(self.level.max()) + 1):
            w = width * (2 if k == 0 else 1)
            self.links.append(flat[at : at + n * w].reshape(n, w))
            at += n * w
        self.fill = [(a >= 0).sum(1) for a in self.links]
        self._seen, self._mark = np.zeros(n, np.int64), 0
        return self

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances, less the constant |q|^2."""
        return self.norm[nodes] - 2 * (self.x[nodes] @ q)

    def _walk(self, q: np.ndarray, start: list[tuple[float, int]], level: int, keep: int, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
        """The ``keep`` nearest found from ``start`` on a level, nearest first."""
        links, fill = self.links[level], self.fill[level]
        for _, i in start:
            seen[i] = mark
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= keep and d > -best[0][0]:
                break
            near = links[i, : fill[i]]
            near = near[seen[near] != mark]
            if not near.size:
                continue
            seen[near] = mark
            far = self._far(q, near)
            if len(best) >= keep:
                ok = far < -best[0][0]
                near, far = near[ok], far[ok]
            for d2, j in zip(far.tolist(), near.tolist()):
                if len(best) < keep:
                    heapq.heappush(best, (-d2, j))
                    heapq.heappush(todo, (d2, j))
                elif d2 < -best[0][0]:
                    heapq.heapreplace(best, (-d2, j))
                    heapq.heappush(todo, (d2, j))
        return sorted((-d, i) for d, i in best)

    def _diverse(self, centre: int, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours nearer to the new node than to each other; the rest fills up."""
        nodes = np.array([i for _, i in found])
        points = self.x[nodes]
        gram = self.norm[nodes][:, None] + self.norm[nodes][None, :] - 2 * points @ points.T
        base = np.array([d for d, _ in found])
        chosen: list[int] = []
        closest = np.full(len(nodes), np.inf)
        for k in range(len(nodes)):
            if len(chosen) >= most:
                break
            if self.norm[centre] + base[k] < closest[k]:
                chosen.append(k)
                closest = np.minimum(closest, gram[k])
        rest = [k for k in range(len(nodes)) if k not in set(chosen)]
        return [int(nodes[k]) for k in (chosen + rest)[:most]]

    def _insert(self, i: int) -> None:
        q = self.x[i]
        at = [(float(self._far(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(self.level[self.entry], -1, -1):
            self._mark += 1
            wanted = self.effort if level <= self.level[i] else 1
            at = self._walk(q, at, level, wanted, self._seen, self._mark)
            if level > self.level[i]:
                continue
            for j in self._link(i, self._diverse(i, at, self.width), level):
                self._back(j, i, level)

    def _link(self, i: int, chosen: list[int], level: int) -> list[int]:
        self.links[level][i, : len(chosen)] = chosen
        self.fill[level][i] = len(chosen)
        return chosen

    def _back(self, j: int, i: int, level: int) -> None:
        """The link from ``j`` back to ``i``; a full list keeps its most diverse."""
        links, fill = self.links[level], self.fill[level]
        if fill[j] < links.shape[1]:
            links[j, fill[j]] = i
            fill[j] += 1
            return
        nodes = np.append(links[j], i)
        far = self._far(self.x[j], nodes)
        order = np.argsort(far, kind="stable")
        self._link(j, self._diverse(j, list(zip(far[order].tolist(), nodes[order].tolist())), links.shape[1]), level)

    def search(self, q: np.ndarray, keep: int) -> list[int]:
        """Numbers of about the ``keep`` nearest rows."""
        if not len(self.x):
            return []
        at = [(float(self._far(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.links) - 1, -1, -1):
            self._mark += 1
            if level > self.level[self.entry]:
                continue
            at = self._walk(q, at, level, keep if level == 0 else 1, self._seen, self._mark)
        return [i for _, i in at]


def usable(vector: Column) -> Column:
    """Vectors with a length above zero and finite components only."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(
    df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int = 10, shard_rows: int = 4096, query_rows: int = 4096,
    width: int = 16, build_effort: int = 64, search_effort: int = 96,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``df`` found for each row of ``queries``, itself left out.

    Scores are Euclidean distances of the original vectors in double precision;
    ties go to the smaller id. Null, empty and zero vectors and such with null or
    non-finite components take no part; nor do null ids, nor vectors of another
    length than most. Repeated (id, vector) rows count once; an id with several
    vectors is as near as its nearest. Fewer than ``k`` candidates give fewer
    rows, an empty table none.
    """
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("v"))
    rows = materialize(rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")))
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not dims:
        return df.sparkSession.createDataFrame([], result)
    dim, n = dims[0]
    asked = queries.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("v"))
    asked = materialize(asked.where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == dim)).dropDuplicates(["id", "v"]))
    m = asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    stored = rows.where(F.col("dim") == dim).select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "v")

    def build(own: pd.DataFrame) -> pd.DataFrame:
        points, back = np.unique(np.stack(own.v.to_numpy()), axis=0, return_inverse=True)
        shuffle = np.random.default_rng(len(points)).permutation(len(points))
        place = np.empty_like(shuffle)
        place[shuffle] = np.arange(len(points))
        node, ids = place[back.ravel()], own.id.to_numpy()
        order = np.lexsort((ids, node))
        graph = SmallWorld(points[shuffle], width, build_effort)
        first = np.searchsorted(node[order], np.arange(len(points) + 1))
        return pd.DataFrame([{"shard": own["shard"].iloc[0], **graph.stored(), "ids": ids[order].tobytes(), "first": first.astype("<i8").tobytes()}])

    schema = "shard int, points binary, levels binary, width int, entry int, links binary, ids binary, first binary"
    graphs = materialize(stored.groupBy("shard").applyInPandas(build, schema))
    # the stated queries against all shards, in blocks of queries that fit a task
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("block")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block, "id", "v")
    spread = graphs.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *graphs.columns)

    def search(graph_rows: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(graph_rows) and len(other):
            g = graph_rows.iloc[0]
            graph = SmallWorld.opened(g.points, g.levels, int(g["width"]), int(g.entry), g.links, dim)
            ids, first = np.frombuffer(g.ids, np.int64), np.frombuffer(g["first"], np.int64)
            for query, v in zip(other.id.to_numpy(), other.v.to_numpy()):
                q = np.asarray(v)
                nodes = np.array(graph.search(q, max(search_effort, k + 1)))
                far = np.sqrt(((graph.x[nodes] - q) ** 2).sum(1))
                best = set()
                for node, d in zip(nodes.tolist(), far.tolist()):
                    # k + 1 ids of a node are enough: one may be the query's own
                    best.update((d, int(i)) for i in ids[first[node] : min(first[node + 1], first[node] + k + 1)] if i != query)
                out += [(int(query), i, d) for d, i in heapq.nsmallest(k, best)]
        found = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        return found.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    pairs = spread.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block"))
    found = pairs.applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    # at most k rows a shard and query
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
