"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  The index posts
vectors in one inverted file a pivot, with the pivot's place in the vector's
order.  A query reads the files of its own pivots, sums how far each posted
vector's places are from its own (the footrule distance; a pivot that only
one of the two names counts as last), takes the nearest vectors by it, and
ranks those again by the inner product in double precision.

Equal vectors are one class, which keeps as many of its smallest ids as any
query can ask for.  Index classes lie in blocks of bounded size; queries go
over all blocks, and each block hands on no more than ``k`` ids a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

#: Pivots, and how many of them may represent a vector: each block takes the
#: number with the least cost, where ranking a candidate again counts as RERANK
#: entries read from inverted files.
PIVOTS, NAMED, RERANK = 256, (8, 16, 32, 64), 20
#: Pivots come from at most so many vectors, those with the smallest hashes.
PIVOT_SAMPLE = 4096
#: How many of a block's classes are ranked again is measured in the block: so
#: many that, of the true nearest of up to TRIALS of its queries, a share of
#: AIM is among them, and LEAST at least.
AIM, TRIALS, LEAST = 0.975, 64, 256
#: Classes in a block of the index, and queries in a block of queries.
BLOCK, QUERIES = 16_384, 4096


def choose_pivots(sample: np.ndarray, n: int = PIVOTS, seed: int = 6) -> np.ndarray:
    """Up to ``n`` distinct rows of ``sample``, at random."""
    rng = np.random.default_rng(seed)
    return sample[rng.permutation(len(sample))[:n]]


def named(vectors: np.ndarray, pivots: np.ndarray, m: int = NAMED[-1]) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; by angle, equal ones by number."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True) * np.linalg.norm(pivots, axis=1)
    return np.argsort(-(vectors @ pivots.T) / norms, axis=1, kind="stable")[:, :m]


class Block:
    """The inverted files of one block: for each pivot, the rows that name it and its place there."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, pivots: int):
        self.vectors, self.n, self.m = vectors, len(vectors), order.shape[1]
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.place = (by // self.m).astype(np.int32), (by % self.m).astype(np.float32)
        self.start = np.searchsorted(flat[by], np.arange(pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of every row from a query's ``order``, less what all have in common."""
        far = np.zeros(self.n, dtype=np.float32)
        for place, pivot in enumerate(order):
            a, b = self.start[pivot], self.start[pivot + 1]
            rows, there = self.rows[a:b], self.place[a:b]
            # Named by both: |place - there| instead of (m - place) + (m - there).
            far[rows] += np.abs(there - place) - (2 * self.m - place - there)
        return far

    def enough(self, vectors: np.ndarray, orders: np.ndarray, k: int) -> int:
        """Candidates that these queries need, by brute force over the block."""
        needed = []
        for v, order in zip(vectors, orders):
            scores = self.vectors @ v
            near = np.argpartition(-scores, min(k, self.n) - 1)[:k]
            far = self.footrule(order)
            needed.extend(np.searchsorted(np.sort(far), far[near], side="right"))
        return max(LEAST, int(np.quantile(needed, AIM))) if needed else LEAST

    def entries(self, orders: np.ndarray) -> float:
        """Entries of inverted files that one of these queries reads."""
        return float(np.diff(self.start)[orders].sum(axis=1).mean()) if len(orders) else 0.0

    def candidates(self, order: np.ndarray, n: int) -> np.ndarray:
        far = self.footrule(order)
        if n >= self.n:
            return np.arange(self.n)
        cut = np.partition(far, n - 1)[n - 1]
        return np.flatnonzero(far <= cut)  # ties at the cut are all ranked


def cheapest(vectors: np.ndarray, asked: np.ndarray, pivots: np.ndarray, k: int) -> tuple[Block, np.ndarray, int]:
    """The block with as many named pivots as cost least for the trial queries, the queries' orders, and the candidates needed."""
    index, orders = named(vectors, pivots), named(asked, pivots)
    tried = np.linspace(0, len(asked) - 1, min(TRIALS, len(asked))).astype(int)
    best = None
    for m in sorted({min(m, index.shape[1]) for m in NAMED}):
        store = Block(vectors, index[:, :m], len(pivots))
        need = store.enough(asked[tried], orders[tried, :m], k)
        cost = store.entries(orders[tried, :m]) + RERANK * min(need, store.n)
        if best is None or cost < best[0]:
            best = (cost, store, orders[:, :m], need)
    return best[1:]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v``: rows with an id whose vector is not null, empty or zero and holds finite numbers only."""
    v = F.col(vector).cast("array<double>")
    d = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull())
    inf = float("inf")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf)) & F.exists("v", lambda x: x != 0)
    return d.where(F.coalesce(fine, F.lit(False)))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """``v, ids``: distinct vectors with up to ``keep`` of their smallest ids.

    Spark cuts a vector that many rows share to ``keep`` ids in each task
    before rows meet, as the rank is bounded.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def search(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` nearest others of ``df``.

    Nearness is the inner product in double precision; ties go to the smaller
    id, and a query never finds its own id.  Rows without an id, and vectors
    that are null, empty, zero or hold a component that is null or not
    finite, take no part; vectors are compared with those of their own length
    only.  Repeated rows count once; an id with several vectors counts as the
    nearest of them.  An empty table gives an empty one.
    """
    spark = df.sparkSession
    ship(spark)
    index = materialize(classes(usable(df, key, vector).distinct(), k + 1), "vectors")
    asked = materialize(usable(queries, key, vector).distinct().withColumn("n", F.size("v")), "queries")
    result = None
    for r in index.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():
        part = _search(index.where(F.size("v") == r["n"]), r["count"], asked.where(F.col("n") == r["n"]).drop("n"), k, block, spark)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return result


def _search(index: DataFrame, size: int, asked: DataFrame, k: int, block: int, spark) -> DataFrame:
    sample = index.orderBy(F.xxhash64(F.lit(6), "v")).limit(PIVOT_SAMPLE).select("v").collect()
    pivots = spark.sparkContext.broadcast(choose_pivots(np.array([r["v"] for r in sample], dtype=float)))
    blocks = max(1, -(-size // block))
    sets = max(1, -(-asked.count() // QUERIES))
    # Each block of queries meets each block of the index in a task of its own.
    of_index = F.pmod(F.xxhash64(F.lit(7), "v"), F.lit(blocks)).cast("int")
    of_queries = F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(sets)).cast("int")
    posted = index.withColumn("block", of_index).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    asking = asked.withColumn("set", of_queries).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(there: pa.Table, here: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if there.num_rows and here.num_rows:
            vectors = matrix(there)
            lists = there.column("ids").combine_chunks()
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            asked_ids, asked_v = here.column("id").to_numpy(), matrix(here)
            store, orders, enough = cheapest(vectors, asked_v, pivots.value, k)
            for q, v, order in zip(asked_ids, asked_v, orders):
                rows = store.candidates(order, enough)
                scores = (store.vectors[rows] * v).sum(axis=1)
                if len(rows) > k + 1:  # its own class may hold nothing else
                    cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    rows, scores = rows[scores >= cut], scores[scores >= cut]
                scores = np.repeat(scores, starts[rows + 1] - starts[rows])
                found = np.concatenate([flat[starts[r] : starts[r + 1]] for r in rows])
                other = found != q
                found, scores = found[other], scores[other]
                best = np.lexsort((found, -scores))[:k]
                out_q.append(np.full(len(best), q)), out_i.append(found[best]), out_s.append(scores[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s)})

    near = posted.groupBy("block", "set").cogroup(asking.groupBy("block", "set")).applyInArrow(answer, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(table: pa.Table) -> np.ndarray:
    """Column ``v``, lists of one length, as rows."""
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def neighbours_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
