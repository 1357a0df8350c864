"""Approximate nearest neighbours by layered proximity graphs, one a shard, kept as a table of links."""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from ..plans.suite import query, table
from .searches import VECTOR

# Executors need not have the package: functions of this module travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a shard, whose vectors and links one task holds.
SHARD = 10_000
#: Rows up to which a vector's distances from all of a shard are formed at once; in larger shards those of the visited only.
ALL = 4096
LINKS = "shard int, node int, key long, vector array<double>, links array<array<int>>"


class Layers:
    """A graph in memory: ``links[i][l]`` are the neighbours of node ``i`` on level ``l``."""

    def __init__(self, vectors: np.ndarray, links: list[list[list[int]]] | None = None):
        self.vectors, self.links = vectors, links or []
        heights = [len(x) for x in self.links]
        self.entry = int(np.argmax(heights)) if heights else 0

    def build(self, m: int, ef: int, seed: int) -> Layers:
        """Insert one vector after the other: down greedily to its level, then links to the ``m`` nearest on each."""
        heights = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(self.vectors))) / math.log(m)).astype(int).tolist()
        lengths: list[list[list[float]]] = []  # of the links
        for i, height in enumerate(heights):
            self.links.append([[] for _ in range(height + 1)])
            lengths.append([[] for _ in range(height + 1)])
            if i == 0:
                continue
            far = self.distances(self.vectors[i], i)
            top = len(self.links[self.entry]) - 1
            at = [self.entry]
            for level in range(top, height, -1):
                at = [self.search(far, at, 1, level)[0][1]]
            for level in range(min(top, height), -1, -1):
                found = self.search(far, at, ef, level)
                at = [j for _, j in found]
                self.links[i][level] = at[:m]
                lengths[i][level] = [d for d, _ in found[:m]]
                most = m if level else 2 * m
                for d, j in found[:m]:
                    theirs, own = self.links[j][level], lengths[j][level]
                    theirs.append(i)
                    own.append(d)
                    if len(theirs) > most:
                        order = np.argsort(own, kind="stable")[:most].tolist()
                        self.links[j][level] = [theirs[x] for x in order]
                        lengths[j][level] = [own[x] for x in order]
            if height > top:
                self.entry = i
        return self

    def far(self, v: np.ndarray, nodes: Sequence[int] | slice) -> np.ndarray:
        gap = self.vectors[nodes] - v
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def distances(self, v: np.ndarray, among: int) -> Callable[[Sequence[int]], list[float]]:
        """A function from nodes under ``among`` to their distances from ``v``."""
        if among > ALL:
            return lambda nodes: self.far(v, nodes).tolist()
        row = self.far(v, slice(among)).tolist()
        return lambda nodes: [row[x] for x in nodes]

    def search(self, far: Callable[[Sequence[int]], list[float]], start: Sequence[int], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest that a best-first walk on one level finds, nearest first, by the distances that ``far`` gives."""
        seen, links = set(start), self.links
        best = [(-d, j) for d, j in zip(far(start), start)]
        todo = [(-d, j) for d, j in best]
        heapq.heapify(best)
        heapq.heapify(todo)
        room = ef - len(best)
        while todo:
            d, j = heapq.heappop(todo)
            if room <= 0 and d > -best[0][0]:
                break
            new = [x for x in links[j][level] if x not in seen]
            if not new:
                continue
            seen.update(new)
            for dist, x in zip(far(new), new):
                if room > 0:
                    heapq.heappush(best, (-dist, x))
                    room -= 1
                elif dist < -best[0][0]:
                    heapq.heapreplace(best, (-dist, x))
                else:
                    continue
                heapq.heappush(todo, (dist, x))
        return sorted((-d, j) for d, j in best)

    def nearest(self, v: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        far, at = self.distances(v, len(self.vectors)), [self.entry]
        for level in range(len(self.links[self.entry]) - 1, 0, -1):
            at = [self.search(far, at, 1, level)[0][1]]
        return self.search(far, at, max(k, ef), 0)[:k]


@dataclass
class ProximityGraph:
    """``links`` has a row a vector: its shard, number there, key, vector and neighbours by level."""

    links: DataFrame
    ef: int

    def nearest(self, queries: Sequence[Sequence[float]], k: int) -> DataFrame:
        """``query_id, rank, key, dist``: about the ``k`` nearest by Euclidean distance of every query, numbered as they stand.

        Every shard is searched; a task hands on ``k`` rows a query at most.
        """
        wanted, ef = np.asarray(queries, dtype=float), self.ef

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("node")
            graph = Layers(np.stack(rows["vector"].to_list()), [[x.tolist() for x in own] for own in rows["links"]])
            keys = rows["key"].to_numpy()
            out = [(q, int(keys[j]), d) for q, v in enumerate(wanted) for d, j in graph.nearest(v, k, ef)]
            return pd.DataFrame(out, columns=["query_id", "key", "dist"])

        found = self.links.groupBy("shard").applyInPandas(one, "query_id int, key long, dist double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "key"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "key", "dist")

    def adjacency(self) -> DataFrame:
        """``shard, node, start, neighbours``: level 0 in compressed rows, ``start`` being the links before a node's in its shard."""
        before = Window.partitionBy("shard").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        rows = self.links.select("shard", "node", F.col("links")[0].alias("neighbours"))
        return rows.withColumn("start", F.coalesce(F.sum(F.size("neighbours")).over(before), F.lit(0))).select("shard", "node", "start", "neighbours")


def proximity_graph(df: DataFrame, key: str, vector: str, m: int = 16, construction: int = 40, ef: int = 100, seed: int = 1, shard: int = SHARD) -> ProximityGraph:
    """Graphs over all rows with a vector, in shards of about ``shard`` rows by a hash of the key, which is unique.

    Vectors that are null or hold nulls take no part.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    shards = max(1, -(-rows.count() // shard))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
        graph = Layers(np.stack(rows["vector"].to_list())).build(m, construction, seed)
        return rows.assign(node=range(len(rows)), links=graph.links)[["shard", "node", "key", "vector", "links"]]

    placed = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return ProximityGraph(written(placed.groupBy("shard").applyInPandas(one, LINKS), "links"), ef)


def _graph(spark, sf) -> ProximityGraph:
    return proximity_graph(table(spark, sf, "embeddings"), "vec_id", "embedding", shard=1000)


@query()
def proximity_nearest(spark, sf):
    """Approximate neighbours with their distances; no SQL, as recall is below 1."""
    return _graph(spark, sf).nearest([VECTOR], 10)


#: Queries by which recall is measured, in a hashed order.
MEASURED = 200


@query(f"SELECT least({MEASURED}, count(*)) AS queries, true AS enough FROM embeddings")
def proximity_recall(spark, sf):
    """Mean recall at 10 against brute force, of ``MEASURED`` rows as queries; at least 0.9."""
    from ..functions.metrics import EUCLID, Metric
    from .similarity import batch_knn

    e = table(spark, sf, "embeddings")
    some = e.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED)
    asked = some.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).collect()
    ids = spark.createDataFrame([(i, r["vec_id"]) for i, r in enumerate(asked)], "query_id int, asked long")
    found = _graph(spark, sf).nearest([r["v"] for r in asked], 10).join(F.broadcast(ids), "query_id").select(F.col("asked").alias("query_id"), F.col("key").alias("vec_id"))
    truth = batch_knn(e, some, [Metric("embedding", EUCLID)], [1.0], 10, "vec_id").select("query_id", "vec_id")
    hit = truth.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return hit.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


@query("SELECT count(*) AS nodes, true AS consistent FROM embeddings")
def proximity_adjacency(spark, sf):
    """Nodes of the compressed rows, and whether every node's links begin where those before it end."""
    rows = _graph(spark, sf).adjacency()
    ends = F.coalesce(F.lag(F.col("start") + F.size("neighbours")).over(Window.partitionBy("shard").orderBy("node")), F.lit(0))
    return rows.withColumn("ends", ends).agg(F.count("*").alias("nodes"), F.every(F.col("start") == F.col("ends")).alias("consistent"))
