"""Pivot-distance indexes: an ordinary table with distances to a few pivots, and exact pruning by them."""

from __future__ import annotations

import json
import re
import uuid
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import Metric, checked_weights, distance, weighted
from .similarity import knn_search

#: Bytes that a bucket of a new index is meant to hold, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 65_536


@dataclass
class PivotIndex:
    """An index in the folder ``path``: rows, the buckets' ranges, and what was deleted, by version.

    ``table`` has the rows with ``bucket`` and a distance column a metric and
    pivot; ``summary`` has their ranges by bucket.  A change adds a version:
    new rows in buckets of their own, deleted ones as keys that hold for the
    versions up to then.
    """

    spark: SparkSession
    path: str
    name: str
    metrics: tuple[Metric, ...]
    pivots: list[list[Any]]
    key: str
    version: int = 0

    @property
    def table(self) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/rows-{v}" for v in self._versions("rows")])
        gone = self._versions("gone")
        if not gone:
            return rows.drop("index_version")
        keys = self.spark.read.parquet(*[f"{self.path}/gone-{v}" for v in gone])
        old = F.col(self.key).eqNullSafe(F.col("gone_key")) & (F.col("index_version") <= F.col("gone_version"))
        return rows.join(keys, old, "left_anti").drop("index_version")

    @property
    def summary(self) -> DataFrame:
        """Ranges by bucket; those of deleted rows stay until the index is made anew."""
        return self.spark.read.parquet(*[f"{self.path}/summary-{v}" for v in self._versions("summary")])

    def bound(self, query: Sequence[Any], weights: Sequence[float], radius: float) -> Column:
        """What every row within ``radius`` meets, by the triangle inequality; plain ranges, which reach the scan."""
        keep = F.lit(True)
        far = pivot_distances(self.spark, self, query)
        for m, w in enumerate(checked_weights(self.metrics, weights)):
            for p in range(len(self.pivots)):
                if w and far[m][p] is not None:
                    reach = radius / w * (1 + 1e-9) + 1e-9
                    keep = keep & F.col(f"pd_{m}_{p}").between(far[m][p] - reach, far[m][p] + reach)
        return keep

    def range_search(self, query: Sequence[Any], weights: Sequence[float], radius: float) -> DataFrame:
        rows = self.table.where(self.bound(query, weights, radius))
        found = rows.withColumn("dist", weighted(self.metrics, query, weights)).where(F.col("dist") <= radius)
        return found.drop("bucket", *self._columns())

    def knn_search(self, query: Sequence[Any], weights: Sequence[float], k: int) -> DataFrame:
        """Exact: the k-th distance within the nearest buckets bounds the radius of a range search."""
        far = pivot_distances(self.spark, self, query)
        gap = F.lit(0.0)
        for m, w in enumerate(checked_weights(self.metrics, weights)):
            for p in range(len(self.pivots)):
                if w and far[m][p] is not None:
                    q = F.lit(far[m][p])
                    gap = F.greatest(gap, F.lit(w) * F.greatest(F.col(f"lo_{m}_{p}") - q, q - F.col(f"hi_{m}_{p}"), F.lit(0.0)))
        order = self.summary.select("bucket", "n", gap.alias("gap"))
        upto = F.sum("n").over(Window.orderBy("gap", "bucket")) - F.col("n")
        near = order.withColumn("before", upto).where(F.col("before") < k).select("bucket")
        sample = knn_search(self.table.join(F.broadcast(near), "bucket", "left_semi"), self.metrics, query, weights, k, self.key)
        stats = sample.agg(F.max("dist").alias("r"), F.count("*").alias("n")).first()
        rows = self.table if stats["n"] < k else self.table.where(self.bound(query, weights, stats["r"]))
        return knn_search(rows, self.metrics, query, weights, k, self.key).drop("bucket", *self._columns())

    def partition_statistics(self) -> DataFrame:
        """Count, least, largest, mean and percentiles of bucket sizes."""
        return self.summary.agg(
            F.count("*").alias("buckets"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"),
            *[F.percentile("n", p / 100).alias(f"p{p}") for p in (5, 25, 50, 75, 95)],
        )

    def insert(self, rows: DataFrame) -> None:
        """Add rows, columns matched by name; they lie in buckets of their own."""
        self.version += 1
        self._write(rows.select(*[c for c in self.table.columns if c in rows.columns and c != "bucket"]), max(1, min(MOST_BUCKETS, _size(rows) // BUCKET_BYTES)))
        self._describe()

    def delete(self, query: Sequence[Any]) -> None:
        """Take away the rows at distance 0 from a record in every metric; only their keys are written."""
        same = self.range_search(query, [1.0] * len(self.metrics), 0.0)
        self.version += 1
        gone = same.select(F.col(self.key).alias("gone_key"), F.lit(self.version - 1).alias("gone_version"))
        gone.write.parquet(f"{self.path}/gone-{self.version}")
        self._describe()

    def _write(self, df: DataFrame, buckets: int) -> None:
        cols = {f"pd_{m}_{p}": distance(metric, self.pivots[p][m]) for p in range(len(self.pivots)) for m, metric in enumerate(self.metrics)}
        order = [c for c in cols if c.endswith("_0")]
        rows = df.withColumns(cols) if cols else df
        spread = rows.repartitionByRange(buckets, *order) if order else rows.coalesce(1)
        first = 0 if not self.version else (self.summary.agg(F.max("bucket")).first()[0] or 0) + 1
        out = spread.withColumns({"bucket": F.spark_partition_id() + F.lit(first), "index_version": F.lit(self.version)})
        out.write.parquet(f"{self.path}/rows-{self.version}")
        ranges = [f(c).alias(c.replace("pd_", p)) for c in cols for f, p in ((F.min, "lo_"), (F.max, "hi_"))]
        written = self.spark.read.parquet(f"{self.path}/rows-{self.version}")
        written.groupBy("bucket").agg(F.count("*").alias("n"), *ranges).coalesce(1).write.parquet(f"{self.path}/summary-{self.version}")

    def _describe(self) -> None:
        """Write what the index is, last: a version that was not finished is never read."""
        plain = [[float(v) if isinstance(v, Decimal) else v for v in p] for p in self.pivots]
        text = json.dumps({"name": self.name, "metrics": [[m.column, m.kind, m.most] for m in self.metrics], "pivots": plain, "key": self.key}, default=str)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/index-{self.version}")

    def _versions(self, kind: str) -> list[int]:
        return sorted(v for k, v in _listed(self.spark, self.path, r"(\w+)-(\d+)") if k == kind and int(v) <= self.version)

    def _columns(self) -> list[str]:
        return [f"pd_{m}_{p}" for m in range(len(self.metrics)) for p in range(len(self.pivots))]


def pivot_distances(spark: SparkSession, index: PivotIndex, query: Sequence[Any]) -> list[list[float | None]]:
    """Distances of a query record from all pivots, in one row."""
    cols = [_literal(m, p[i]).alias(f"v_{i}_{j}") for j, p in enumerate(index.pivots) for i, m in enumerate(index.metrics)]
    row = spark.range(1).select(*cols)
    out = row.select(*[distance(m, query[i], F.col(f"v_{i}_{j}")).alias(f"d_{i}_{j}") for j in range(len(index.pivots)) for i, m in enumerate(index.metrics)]).first()
    return [[out[f"d_{i}_{j}"] for j in range(len(index.pivots))] for i in range(len(index.metrics))]


def _literal(m: Metric, v: Any) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)


def choose_pivots(df: DataFrame, metrics: Sequence[Metric], n: int, seed: int = 1, sample: int = 2000) -> list[list[Any]]:
    """Up to ``n`` records far from each other, out of a bounded random sample."""
    rows = df.select(*[m.column for m in metrics]).na.drop().orderBy(F.rand(seed)).limit(sample).cache()
    first = rows.first()
    if first is None:
        return []
    pivots = [list(first)]
    while len(pivots) < n:
        near = F.least(*[weighted(metrics, p, [1.0] * len(metrics)) for p in pivots]) if len(pivots) > 1 else weighted(metrics, pivots[0], [1.0] * len(metrics))
        far = rows.withColumn("d", near).orderBy(F.desc("d")).first()
        if not far["d"]:
            break
        pivots.append(list(far)[:-1])
    rows.unpersist()
    return pivots


def _listed(spark: SparkSession, folder: str, pattern: str) -> list[tuple[str, ...]]:
    """Groups of the names in a folder of any file system that match a pattern."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return [m.groups() for m in (re.fullmatch(pattern, x) for x in names) if m]


def _size(df: DataFrame) -> int:
    """The planner's estimate of a table's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Catalog:
    """Indexes by table and name.

    They live in ``folder`` and last as long as it does: another catalog of
    the same folder, in another application too, finds them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.found = spark, folder.rstrip("/"), {}
        for table, name, token in _listed(spark, self.folder, r"(\w+)-(\w+)-([0-9a-f]{32})"):
            index = self._opened(f"{self.folder}/{table}-{name}-{token}")
            if index is not None:
                self.found[table, name] = index

    def _opened(self, path: str) -> PivotIndex | None:
        versions = [int(v) for (v,) in _listed(self.spark, path, r"index-(\d+)")]
        if not versions:
            return None
        got = json.loads(self.spark.read.text(f"{path}/index-{max(versions)}").first()[0])
        return PivotIndex(self.spark, path, got["name"], tuple(Metric(*m) for m in got["metrics"]), got["pivots"], got["key"], max(versions))

    def create(self, table: str, df: DataFrame, metrics: Sequence[Metric], name: str, key: str, pivots: int = 2, buckets: int | None = None) -> PivotIndex:
        """Write ``df`` in the order of its distance from the first pivot, with all pivot distances.

        The number of buckets follows the table's size, 16 at least, unless
        one is given.  An index of that name is kept as it is, with a warning.
        """
        missing = [m.column for m in metrics if m.column not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        if (table, name) in self.found:
            warnings.warn(f"index {name} of {table} exists", stacklevel=2)
            return self.found[table, name]
        if buckets is None:
            buckets = max(16, min(MOST_BUCKETS, _size(df) // BUCKET_BYTES))
        path = f"{self.folder}/{table}-{name}-{uuid.uuid4().hex}"
        index = PivotIndex(self.spark, path, name, tuple(metrics), choose_pivots(df, metrics, pivots), key)
        index._write(df, buckets)
        index._describe()
        self.found[table, name] = index
        return index

    def ensure(self, table: str, df: DataFrame, metrics: Sequence[Metric], key: str, name: str = "by_first_query") -> PivotIndex:
        """The table's index over these metrics; the first query makes it."""
        for (t, _), index in sorted(self.found.items()):
            if t == table and index.metrics == tuple(metrics):
                return index
        return self.create(table, df, metrics, name, key)

    def get(self, table: str, name: str) -> PivotIndex:
        if (table, name) not in self.found:
            raise KeyError(f"no index {name} of {table}")
        return self.found[table, name]

    def of(self, table: str) -> PivotIndex | None:
        return next((v for (t, _), v in sorted(self.found.items()) if t == table), None)

    def drop(self, table: str, name: str) -> None:
        """Forget the index and delete its files."""
        index = self.get(table, name)
        del self.found[table, name]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def show(self, table: str | None = None) -> DataFrame:
        rows = [(n,) for t, n in sorted(self.found) if table in (None, t)]
        return self.spark.createDataFrame(rows, "index string")
