"""Tree indexes as tables: rows carry the number of their leaf, and the inner nodes are a small table of their own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ANGLE, EUCLID, L1, Metric, distance
from ..plans.storage import written
from ..plans.suite import query, table
from .kernels import leaf_task
from .searches import _L2, _V, VECTOR

#: Most leaves of a tree; the inner nodes fit in a driver whatever the table holds.
MOST_LEAVES = 4096
#: Rows from which the inner nodes are fitted; all rows are indexed.
SAMPLE = 20_000


# ---------------------------------------------------------------- vantage points


@dataclass
class VantageTree:
    """``table`` has the rows with ``leaf``; an inner node has a record and the distance that parts its halves.

    Node 1 is the root, 2n the half within the distance and 2n + 1 the other;
    leaf 0 holds rows without a distance, which no search finds.
    """

    table: DataFrame
    metric: Metric
    key: str
    depth: int
    nodes: DataFrame
    reach: dict[int, float]
    sizes: dict[int, int]

    def _from_nodes(self, record: Any) -> dict[int, float]:
        """Distances of a record from the vantage points, of which there are ``MOST_LEAVES`` at most."""
        d = distance(Metric("vantage", self.metric.kind, self.metric.most), _record(self.metric, record))
        return {r["node"]: r["d"] for r in self.nodes.select("node", d.alias("d")).collect()}

    def _leaves(self, far: dict[int, float], radius: float) -> list[int]:
        todo, out = [1], []
        slack = 1e-9 * (1 + radius)
        while todo:
            node = todo.pop()
            if node not in self.reach:
                out.append(node)
                continue
            if far[node] - radius <= self.reach[node] + slack:
                todo.append(2 * node)
            if far[node] + radius + slack >= self.reach[node]:
                todo.append(2 * node + 1)
        return out

    def _rows(self, leaves: Sequence[int], record: Any) -> DataFrame:
        rows = self.table.where(F.col("leaf").isin(sorted(leaves)))
        return rows.withColumn("dist", distance(Metric("vantage_at", self.metric.kind, self.metric.most), _record(self.metric, record))).drop("leaf", "vantage_at")

    def ball(self, record: Any, radius: float) -> DataFrame:
        """Rows within ``radius``, with ``dist``; exact."""
        return self._rows(self._leaves(self._from_nodes(record), radius), record).where(F.col("dist") <= radius)

    def near(self, record: Any, k: int) -> DataFrame:
        """About the ``k`` nearest rows: the best of the leaf that the record falls into, or of the least subtree with ``k`` rows."""
        return self._near(self._from_nodes(record), record, k)

    def _near(self, far: dict[int, float], record: Any, k: int) -> DataFrame:
        node = 1
        while node in self.reach:
            node = 2 * node + (far[node] > self.reach[node])
        while node > 1 and sum(self.sizes.get(x, 0) for x in self._under(node)) < k:
            node //= 2
        return self._rows(self._under(node), record).orderBy("dist", self.key).limit(k)

    def nearest(self, record: Any, k: int) -> DataFrame:
        """The ``k`` nearest rows, ties to the smaller key; exact: what ``near`` finds bounds the radius of a ball."""
        far = self._from_nodes(record)
        got = self._near(far, record, k).agg(F.max("dist").alias("r"), F.count("*").alias("n")).first()
        leaves = self._under(1) if got["n"] < k else self._leaves(far, got["r"])
        return self._rows(leaves, record).orderBy("dist", self.key).limit(k)

    def _under(self, node: int) -> list[int]:
        todo, out = [node], []
        while todo:
            x = todo.pop()
            todo += [2 * x, 2 * x + 1] if x in self.reach else []
            out += [] if x in self.reach else [x]
        return out

    def balance(self) -> DataFrame:
        """``node, inside, outside``: rows in both halves of every inner node."""
        rows = [(n, *[sum(self.sizes.get(x, 0) for x in self._under(2 * n + i)) for i in (0, 1)]) for n in sorted(self.reach)]
        return self.table.sparkSession.createDataFrame(rows, "node int, inside long, outside long")


def _record(m: Metric, v: Any) -> Any:
    return [float(v)] if m.kind in (L1, EUCLID) and isinstance(v, (int, float)) else v


def _placed(rows: DataFrame, nodes: DataFrame, metric: Metric, levels: int) -> DataFrame:
    """Rows sent down ``levels`` levels from the leaves that they are in; no row moves to another task."""
    if metric.kind in (L1, EUCLID):
        return _placed_vectors(rows, nodes, metric, levels)
    by = F.broadcast(nodes.select(F.col("node").alias("leaf"), "vantage", "reach"))
    at = Metric("vantage_at", metric.kind, metric.most)
    for _ in range(levels):
        d = distance(at, F.col("vantage"))
        down = F.when(F.col("reach").isNull(), F.col("leaf")).when(d.isNull(), F.lit(0)).otherwise(F.col("leaf") * 2 + (d > F.col("reach")).cast("int"))
        rows = rows.join(by, "leaf", "left").withColumn("leaf", down).drop("vantage", "reach")
    return rows


def _placed_vectors(rows: DataFrame, nodes: DataFrame, metric: Metric, levels: int) -> DataFrame:
    """The same in one pass over batches of rows, instead of a join and an interpreted distance a level."""
    known = {r["node"]: (r["vantage"], r["reach"]) for r in nodes.collect()}  # MOST_LEAVES at most
    sent = rows.sparkSession.sparkContext.broadcast(known)
    return rows.mapInArrow(leaf_task(sent, metric.kind, metric.most, levels, "vantage_at"), rows.schema)


def vantage_tree(df: DataFrame, metric: Metric, key: str, leaf: int = 256, sample: int = SAMPLE, seed: int = 1) -> VantageTree:
    """A tree with leaves of about ``leaf`` rows, ``MOST_LEAVES`` leaves at most.

    Vantage points and medians come from ``sample`` rows in a hashed order;
    any of them prune exactly, the sample only decides the balance.  A node
    whose rows lie at one distance is not cut again.
    """
    at = F.col(metric.column)
    if metric.kind in (L1, EUCLID, ANGLE):
        at = at.cast("array<double>") if dict(df.dtypes)[metric.column].startswith("array") else F.when(at.isNotNull(), F.array(at.cast("double")))
    rows = df.withColumns({"vantage_at": at, "leaf": F.when(at.isNull(), 0).otherwise(1)})
    spark, n, depth = df.sparkSession, df.count(), 0
    while depth < 12 and 2**depth * leaf < n:
        depth += 1
    some = rows.where("leaf = 1").select(key, "vantage_at", "leaf").orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample).cache()
    kind = dict(rows.dtypes)["vantage_at"]
    schema = f"node int, vantage {kind}, reach double"
    nodes: list[tuple] = []
    for level in range(depth):
        placed = _placed(some, spark.createDataFrame(nodes, schema), metric, level) if nodes else some
        placed = placed.where(F.col("leaf") >= 2**level)
        chosen = placed.groupBy("leaf").agg(F.min_by("vantage_at", F.xxhash64(F.lit(seed + level), key)).alias("vantage"))
        d = distance(Metric("vantage_at", metric.kind, metric.most), F.col("vantage"))
        cut = placed.join(F.broadcast(chosen), "leaf").groupBy("leaf").agg(F.first("vantage").alias("vantage"), F.percentile_approx(d, 0.5, 1000).alias("reach"), F.max(d).alias("most"))
        new = [tuple(r) for r in cut.where("reach < most").select("leaf", "vantage", "reach").collect()]
        nodes += new
        if not new:
            break
    some.unpersist()
    small = spark.createDataFrame(nodes, schema)
    placed = _placed(rows, small, metric, depth) if nodes else rows
    cut = placed.repartitionByRange("leaf", F.xxhash64(key)).sortWithinPartitions("leaf")
    out = written(cut, "vantage-rows")
    sizes = {r["leaf"]: r["count"] for r in out.groupBy("leaf").count().collect()}
    return VantageTree(out, metric, key, depth, small, {n: r for n, _, r in nodes}, sizes)


# ---------------------------------------------------------------- rectangles


@dataclass
class RectangleTree:
    """``table`` has the rows with ``leaf``; ``nodes`` has ``level, node, parent, n`` and the corners of each node's box.

    ``lo`` and ``hi`` name the columns of a row's own box; for points they
    are the same.  ``cuts`` are the borders by which rows find their leaves.
    """

    table: DataFrame
    nodes: DataFrame
    lo: tuple[str, ...]
    hi: tuple[str, ...]
    cuts: tuple[DataFrame, ...]
    slices: int
    levels: int
    capacity: int
    fanout: int

    def _found(self, test) -> DataFrame:
        """Rows in leaves that pass ``test`` and whose ancestors do, and that pass it themselves; rows without a corner are in none."""
        d = range(len(self.lo))
        hit = None
        for level in range(self.levels - 1, -1, -1):
            here = self.nodes.where(F.col("level") == level).where(test([f"lo_{i}" for i in d], [f"hi_{i}" for i in d]))
            if hit is not None:
                here = here.join(F.broadcast(hit), F.col("parent") == F.col("above"), "left_semi")
            hit = here.select(F.col("node").alias("above"))
        rows = self.table.where(test(self.lo, self.hi))
        return rows.join(F.broadcast(hit), F.col("leaf") == F.col("above"), "left_semi").drop("leaf")

    def box(self, low: Sequence[float], high: Sequence[float]) -> DataFrame:
        """Rows whose points lie in a box, borders included, or whose boxes meet it."""

        def test(lo: Sequence[str], hi: Sequence[str]) -> Column:
            keep = F.lit(True)
            for a, b, x, y in zip(lo, hi, low, high):
                keep = keep & (F.col(a) <= F.lit(float(y))) & (F.col(b) >= F.lit(float(x)))
            return keep

        return self._found(test)

    def ball(self, centre: Sequence[float], radius: float) -> DataFrame:
        """Rows whose points, or the nearest points of whose boxes, lie within ``radius`` of a point, with ``dist``."""
        return self._found(lambda lo, hi: self._gap(lo, hi, centre) <= radius).withColumn("dist", self._gap(self.lo, self.hi, centre))

    @staticmethod
    def _gap(lo: Sequence[str], hi: Sequence[str], centre: Sequence[float]) -> Column:
        total = F.lit(0.0)
        for a, b, x in zip(lo, hi, centre):
            side = F.greatest(F.col(a) - F.lit(float(x)), F.lit(float(x)) - F.col(b), F.lit(0.0))
            total = total + side * side
        return F.when(F.col(lo[0]).isNotNull(), F.sqrt(total))

    def nearest(self, centre: Sequence[float], k: int, key: str) -> DataFrame:
        """The ``k`` nearest rows, ties to the smaller key: the nearest leaves with ``k`` rows bound the radius of a ball."""
        corners = [f"lo_{i}" for i in range(len(self.lo))], [f"hi_{i}" for i in range(len(self.lo))]
        leaves = self.nodes.where("level = 0").select("node", "n", self._gap(*corners, centre).alias("gap")).orderBy("gap", "node").collect()
        some, n = [], 0
        for leaf in leaves:
            some.append(leaf["node"])
            n += leaf["n"]
            if n >= k:
                break
        ranked = self.table.where(F.col("leaf").isin(some)).withColumn("dist", self._gap(self.lo, self.hi, centre)).orderBy("dist", key).limit(k)
        radius = ranked.agg(F.max("dist")).first()[0] if n >= k else None
        rows = self.table.drop("leaf").withColumn("dist", self._gap(self.lo, self.hi, centre)) if radius is None else self.ball(centre, radius)
        return rows.where("dist IS NOT NULL").orderBy("dist", key).limit(k)

    def insert(self, rows: DataFrame) -> RectangleTree:
        """The tree with more rows: they go to leaves by the old borders, whose boxes grow.

        Where a leaf then has more than four times its capacity, the whole is
        cut anew.
        """
        both = self.table.drop("leaf").unionByName(rows.select(*self.table.drop("leaf").columns))
        grown = self.table.unionByName(_sliced(rows, self.lo, self.hi, self.cuts, self.slices).select(*self.table.columns))
        nodes, levels = _boxes(grown, self.lo, self.hi, self.fanout)
        if (nodes.where("level = 0").agg(F.max("n")).first()[0] or 0) > 4 * self.capacity:
            return rectangle_tree(both, self.lo, self.hi, self.capacity, self.fanout)
        return replace(self, table=grown, nodes=nodes, levels=levels)


def _middle(lo: str, hi: str) -> Column:
    return (F.col(lo) + F.col(hi)).cast("double") / 2


def _sliced(rows: DataFrame, lo: Sequence[str], hi: Sequence[str], cuts: Sequence[DataFrame], slices: int) -> DataFrame:
    """``leaf`` for every row, one dimension after the other; rows without a corner get none."""
    rows = rows.withColumn("leaf", F.lit(0))
    for a, b, cut in zip(lo, hi, cuts):
        x = _middle(a, b)
        step = F.size(F.filter("borders", lambda v: v < x))
        rows = rows.join(F.broadcast(cut), F.col("leaf") == F.col("cut"), "left")
        rows = rows.withColumn("leaf", F.when(x.isNotNull(), F.col("leaf") * slices + F.greatest(F.lit(0), F.coalesce(step, F.lit(0))))).drop("cut", "borders")
    return rows


def _boxes(rows: DataFrame, lo: Sequence[str], hi: Sequence[str], fanout: int) -> tuple[DataFrame, int]:
    d = range(len(lo))
    corners = [f(F.col(c)).cast("double").alias(f"{p}_{i}") for i in d for f, p, c in ((F.min, "lo", lo[i]), (F.max, "hi", hi[i]))]
    level = written(rows.where("leaf IS NOT NULL").groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("n"), *corners), "boxes")
    above = [f(f"{p}_{i}").alias(f"{p}_{i}") for i in d for f, p in ((F.min, "lo"), (F.max, "hi"))]
    out, levels, number = None, 0, level.agg(F.max("node")).first()[0] or 0
    while True:
        one = level.withColumns({"level": F.lit(levels), "parent": F.floor(F.col("node") / fanout).cast("int")})
        out = one if out is None else out.unionByName(one)
        levels += 1
        if number == 0:
            return written(out.coalesce(1), "nodes"), levels
        number //= fanout
        level = level.groupBy(F.floor(F.col("node") / fanout).cast("int").alias("node")).agg(F.sum("n").alias("n"), *above)


def rectangle_tree(df: DataFrame, lo: Sequence[str], hi: Sequence[str] | None = None, capacity: int = 256, fanout: int = 16) -> RectangleTree:
    """Sort-tile loading: slices of equal counts by the first dimension's middle, each cut by the next, and so on.

    Leaves have about ``capacity`` rows; there are ``MOST_LEAVES`` at most, so
    the borders and boxes are of bounded size.  ``lo`` alone indexes points.
    """
    lo, hi = tuple(lo), tuple(hi or lo)
    n = df.count()
    wanted = max(1, min(MOST_LEAVES, -(-n // capacity)))
    slices = 1
    while (slices + 1) ** len(lo) <= MOST_LEAVES and slices ** len(lo) < wanted:
        slices += 1
    cuts: list[DataFrame] = []
    shares = [i / slices for i in range(1, slices)] or [1.0]
    for i in range(len(lo)):
        placed = _sliced(df, lo[:i], hi[:i], cuts, slices)
        found = placed.where(F.col("leaf").isNotNull()).groupBy(F.col("leaf").alias("cut")).agg(F.percentile_approx(_middle(lo[i], hi[i]), shares, 10_000).alias("borders"))
        cuts.append(written(found.coalesce(1), "borders"))
    rows = _sliced(df, lo, hi, cuts, slices).repartitionByRange("leaf", F.xxhash64(*lo)).sortWithinPartitions("leaf")
    out = written(rows, "rectangle-rows")
    nodes, levels = _boxes(out, lo, hi, fanout)
    return RectangleTree(out, nodes, lo, hi, tuple(cuts), slices, levels, max(capacity, -(-n // slices ** len(lo))), fanout)


# ---------------------------------------------------------------- queries

_AT = "sqrt((p_size - 20.0) * (p_size - 20.0) + (p_retailprice - 1000.0) * (p_retailprice - 1000.0))"


@query(f"SELECT vec_id, round({_L2.format(v=_V)}, 6) AS dist FROM embeddings WHERE {_L2.format(v=_V)} <= 1.1")
def vantage_ball(spark, sf):
    tree = vantage_tree(table(spark, sf, "embeddings"), Metric("embedding", EUCLID), "vec_id", leaf=32)
    return tree.ball(VECTOR, 1.1).select("vec_id", F.round("dist", 6).alias("dist"))


@query(f"SELECT vec_id FROM embeddings ORDER BY {_L2.format(v=_V)}, vec_id LIMIT 10")
def vantage_nearest(spark, sf):
    tree = vantage_tree(table(spark, sf, "embeddings"), Metric("embedding", EUCLID), "vec_id", leaf=32)
    return tree.nearest(VECTOR, 10).select("vec_id")


@query()
def vantage_near(spark, sf):
    """Approximate: the rows of one leaf; which they are depends on the vantage points, so no SQL."""
    tree = vantage_tree(table(spark, sf, "embeddings"), Metric("embedding", EUCLID), "vec_id", leaf=32)
    return tree.near(VECTOR, 10).select("vec_id", "dist")


@query("SELECT p_partkey, CAST(levenshtein(p_name, 'blue rod') AS DOUBLE) AS dist FROM part WHERE levenshtein(p_name, 'blue rod') <= 3")
def vantage_edit(spark, sf):
    tree = vantage_tree(table(spark, sf, "part"), Metric("p_name", "edit"), "p_partkey", leaf=32)
    return tree.ball("blue rod", 3).select("p_partkey", "dist")


@query("SELECT count(*) AS n FROM embeddings")
def vantage_balance(spark, sf):
    """Rows in both halves of the root, which are all."""
    tree = vantage_tree(table(spark, sf, "embeddings"), Metric("embedding", EUCLID), "vec_id", leaf=32)
    return tree.balance().where("node = 1").select((F.col("inside") + F.col("outside")).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 905.0 AND 990.0")
def rectangle_box(spark, sf):
    return rectangle_tree(table(spark, sf, "part"), ["p_size", "p_retailprice"], capacity=32).box([10, 905.0], [20, 990.0]).select("p_partkey")


@query(f"SELECT p_partkey, round({_AT}, 6) AS dist FROM part WHERE {_AT} <= 15")
def rectangle_ball(spark, sf):
    tree = rectangle_tree(table(spark, sf, "part"), ["p_size", "p_retailprice"], capacity=32)
    return tree.ball([20, 1000.0], 15).select("p_partkey", F.round("dist", 6).alias("dist"))


@query(f"SELECT p_partkey FROM part ORDER BY {_AT}, p_partkey LIMIT 12")
def rectangle_nearest(spark, sf):
    return rectangle_tree(table(spark, sf, "part"), ["p_size", "p_retailprice"], capacity=32).nearest([20, 1000.0], 12, "p_partkey").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size <= 20 AND p_size + 5 >= 10 AND p_retailprice <= 990.0 AND p_retailprice + 3 >= 905.0")
def rectangle_boxes(spark, sf):
    """Rows with a box each."""
    part = table(spark, sf, "part").withColumns({"to_size": F.col("p_size") + 5, "to_price": F.col("p_retailprice") + 3})
    return rectangle_tree(part, ["p_size", "p_retailprice"], ["to_size", "to_price"], capacity=32).box([10, 905.0], [20, 990.0]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 905.0 AND 990.0 UNION ALL SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_size BETWEEN 10 AND 20 AND p_retailprice + 7 BETWEEN 905.0 AND 990.0")
def rectangle_insert(spark, sf):
    part = table(spark, sf, "part")
    tree = rectangle_tree(part, ["p_size", "p_retailprice"], capacity=32)
    return tree.insert(part.where("p_size % 2 = 0").withColumn("p_retailprice", F.col("p_retailprice") + 7)).box([10, 905.0], [20, 990.0]).select("p_partkey")
