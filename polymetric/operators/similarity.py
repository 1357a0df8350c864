"""Range and nearest-neighbour search by weighted multi-metric distance."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ANGLE, EDIT, EUCLID, L1, Metric, checked_weights, distance, weighted
from .kernels import Scale, batch_task, grouped

#: Query records of a batch that are broadcast; a larger batch goes in blocks of this many.
BATCH = 10_000
#: Rows that a task compares with a block of query vectors.
ROWS = 8192


def range_search(df: DataFrame, metrics: Sequence[Metric], query: Sequence[Any], weights: Sequence[float], radius: float, out: str = "dist") -> DataFrame:
    """Rows of ``df`` at a weighted distance of ``radius`` or less, with the distance.

    Rows with a null attribute of positive weight have no distance and are left out.
    """
    d = weighted(metrics, query, weights, within=radius)
    bounds = [b for m, q, w in zip(metrics, query, checked_weights(metrics, weights)) if w for b in prefilters(m, q, radius / w)]
    for b in bounds:
        df = df.where(b)
    return df.withColumn(out, d).where(F.col(out) <= radius)


def prefilters(m: Metric, query: Any, within: float) -> list[Column]:
    """Cheap conditions that every row within a normalised distance meets; those on scalars reach the scan."""
    reach = within * m.most
    if m.kind in (L1, EUCLID) and isinstance(query, (int, float)):
        slack = 1e-9 * (1 + abs(query) + reach)
        return [F.col(m.column).between(query - reach - slack, query + reach + slack)]
    if m.kind == EDIT:
        return [F.abs(F.length(m.column) - len(query)) <= reach]
    return []


def knn_search(df: DataFrame, metrics: Sequence[Metric], query: Sequence[Any], weights: Sequence[float], k: int, key: str, out: str = "dist") -> DataFrame:
    """The ``k`` rows nearest to the query record, ties to the smaller key: a top-k in each task, then one of those."""
    d = df.withColumn(out, weighted(metrics, query, weights)).where(F.col(out).isNotNull())
    return d.orderBy(out, key).limit(k)


def _pair_distance(metrics: Sequence[Metric], weights: Sequence[float], left: str, right: str) -> Column:
    total = None
    for m, w in zip(metrics, checked_weights(metrics, weights)):
        if not w:
            continue
        a, b = F.col(f"{left}{m.column}"), F.col(f"{right}{m.column}")
        if m.kind == ANGLE:
            b = b.cast("array<double>")
        term = F.lit(w) * distance(m, b, a)
        total = term if total is None else total + term
    return total


def _prepared(df: DataFrame, metrics: Sequence[Metric], key: str, prefix: str) -> DataFrame:
    """Key and attributes under prefixed names; scalars of vector metrics become vectors of one component."""
    types = dict(df.dtypes)
    cols = [F.col(key).alias(f"{prefix}{key}")]
    for m in metrics:
        c = F.col(m.column)
        if m.kind in (L1, EUCLID, ANGLE):
            c = c.cast("array<double>") if types[m.column].startswith("array") else F.array(c.cast("double"))
        cols.append(c.alias(f"{prefix}{m.column}"))
    return df.select(*cols)


def _blocks(queries: DataFrame, key: str) -> list[DataFrame]:
    n = queries.count()
    blocks = max(1, -(-n // BATCH))
    if blocks == 1:
        return [queries]
    part = F.pmod(F.xxhash64(key), F.lit(blocks))
    return [queries.where(part == i) for i in range(blocks)]


def batch_range(df: DataFrame, queries: DataFrame, metrics: Sequence[Metric], weights: Sequence[float], radius: float, key: str) -> DataFrame:
    """``query_id, <key>, dist`` for all query records at once.

    A block of the query set, of counted size, goes to every task.  Where all
    metrics are on vectors, tasks compute in tiles, and the rows of ``df`` are
    dealt to tasks of about ``ROWS``; else they never move.
    """
    if _tiled(df, queries, metrics, weights, key):
        return _batch(df, queries, metrics, weights, key, radius, None)
    data = _prepared(df, metrics, key, "")
    result = None
    for block in _blocks(_prepared(queries, metrics, key, "q_"), f"q_{key}"):
        d = data.crossJoin(F.broadcast(block)).withColumn("dist", _pair_distance(metrics, weights, "", "q_"))
        part = d.where(F.col("dist") <= radius).select(F.col(f"q_{key}").alias("query_id"), key, "dist")
        result = part if result is None else result.unionByName(part)
    return result


def _tiled(df: DataFrame, queries: DataFrame, metrics: Sequence[Metric], weights: Sequence[float], key: str) -> bool:
    types = [dict(x.dtypes) for x in (df, queries)]
    used = [m for m, w in zip(metrics, checked_weights(metrics, weights)) if w]
    numbers = {f"array<{t}>" for t in ("float", "double", "int", "bigint")}
    return all(m.kind in (L1, EUCLID) and t[m.column] in numbers for m in used for t in types) and all(t[key] in ("int", "bigint") for t in types)


def _batch(df: DataFrame, queries: DataFrame, metrics: Sequence[Metric], weights: Sequence[float], key: str, radius: float, k: int | None) -> DataFrame:
    used = [(m, w) for m, w in zip(metrics, checked_weights(metrics, weights)) if w]
    names = [f"v{i}" for i in range(len(used))]
    none = F.lit(-(2**63)).cast("long")  # stands for a null key, which comes first in an order as this does
    pick = [F.coalesce(F.col(key).cast("long"), none).alias("key"), *[F.col(m.column).cast("array<double>").alias(n) for n, (m, _) in zip(names, used)]]
    rows = df.select(*pick)
    dealt = rows.repartition(max(1, -(-rows.count() // ROWS)), "key")
    scale, result = Scale([w for _, w in used], [m.most for m, _ in used]), None
    for block in _blocks(queries.select(*pick), "key"):
        asked, table = {}, block.toArrow()
        ids = table.column("key").to_numpy()
        for lengths, at, matrices in grouped(table, names):
            asked[lengths] = (ids[at], matrices)
        sent = df.sparkSession.sparkContext.broadcast(asked)  # BATCH vectors a metric at most
        task = batch_task(sent, [m.kind for m, _ in used], scale, names, "key", ["query_id", key, "dist"], radius, k)
        part = dealt.mapInArrow(task, f"query_id long, `{key}` long, dist double")
        result = part if result is None else result.unionByName(part)
    id_, own = (F.nullif(F.col(c), none).cast(dict(t.dtypes)[key]).alias(c) for c, t in (("query_id", queries), (key, df)))
    return result.select(id_, own, "dist")


def batch_knn(df: DataFrame, queries: DataFrame, metrics: Sequence[Metric], weights: Sequence[float], k: int, key: str) -> DataFrame:
    """``query_id, rank, <key>, dist`` for all query records at once; a task hands on ``k`` rows a query at most."""
    if _tiled(df, queries, metrics, weights, key):
        near = _batch(df, queries, metrics, weights, key, float("inf"), k)
    else:
        near = batch_range(df, queries, metrics, weights, float("inf"), key)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", key))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "dist")


def similarity_join(left: DataFrame, right: DataFrame, metric: Metric, radius: float, key: str) -> DataFrame:
    """``left_id, right_id, dist`` of pairs within ``radius`` by a scalar metric.

    Values are cut into cells as wide as the radius, so a pair lies in the
    same cell or in neighbouring ones, and the join is one on equal cells.
    """
    if metric.kind not in (L1, EUCLID):
        raise ValueError("cells are defined for scalar metrics")
    width = radius * metric.most
    cell = F.floor(F.col("v") / width).cast("long") if width else F.xxhash64("v")
    a = left.select(F.col(key).alias("left_id"), F.col(metric.column).cast("double").alias("v")).withColumn("cell", cell)
    b = right.select(F.col(key).alias("right_id"), F.col(metric.column).cast("double").alias("v")).withColumn("cell", cell)
    if width:
        b = b.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    a, b = a.withColumnRenamed("v", "a"), b.withColumnRenamed("v", "b")
    d = F.abs(F.col("a") - F.col("b")) / metric.most
    return a.join(b, "cell").withColumn("dist", d).where(F.col("dist") <= radius).select("left_id", "right_id", "dist")


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` with more rows, columns matched by name."""
    return df.unionByName(rows)


def delete(df: DataFrame, metrics: Sequence[Metric], query: Sequence[Any]) -> DataFrame:
    """``df`` without the rows at distance 0 from a record in every metric."""
    same = weighted(metrics, query, [1.0] * len(metrics)) == 0
    return df.where(~F.coalesce(same, F.lit(False)))


def recall(found: DataFrame, truth: DataFrame, on: Sequence[str]) -> float:
    """Share of the true rows that were found."""
    total = truth.count()
    return truth.join(found.select(*on).distinct(), list(on), "left_semi").count() / total if total else 1.0
