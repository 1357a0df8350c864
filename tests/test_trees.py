"""Tree and graph indexes by brute force: nulls, ties, equal rows, empty tables, changes."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from polymetric.functions.metrics import EDIT, EUCLID, L1, Metric
from polymetric.operators import proximity
from polymetric.operators.proximity import proximity_graph
from polymetric.operators.trees import rectangle_tree, vantage_tree

from .test_search import levenshtein

SCHEMA = "id long, v array<double>, s string, x double, y double"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random(), rng.random()], "".join(rng.choices("ab", k=rng.randint(0, 7))), float(rng.randint(0, 40)), rng.random() * 40) for i in range(400)]
    rows += [(400 + i, [0.5, 0.5], "abab", 7.0, 7.0) for i in range(150)] + [(600, None, None, None, 1.0), (601, [0.1, 0.1], "", 3.0, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("column,kind,record,radius", [("v", EUCLID, [0.4, 0.6], 0.2), ("v", L1, [2.0, 2.0], 2.9), ("s", EDIT, "abba", 2), ("x", L1, 7.0, 3.0)])
def test_vantage(data, column, kind, record, radius):
    rows, df = data
    at = SCHEMA.split(", ").index(next(c for c in SCHEMA.split(", ") if c.split()[0] == column))
    far = {EUCLID: math.dist, L1: lambda a, b: sum(map(lambda p, q: abs(p - q), a, b)) if isinstance(a, list) else abs(a - b), EDIT: levenshtein}[kind]
    want = sorted((far(r[at], record), r[0]) for r in rows if r[at] is not None)
    tree = vantage_tree(df, Metric(column, kind), "id", leaf=16)
    assert sorted(r["id"] for r in tree.ball(record, radius).collect()) == sorted(i for d, i in want if d <= radius)
    assert [r["id"] for r in tree.nearest(record, 20).collect()] == [i for _, i in want[:20]]
    assert len(tree.near(record, 20).collect()) == 20 and len(tree.nearest(record, 1000).collect()) == len(want)
    top = tree.balance().where("node = 1").first()
    assert top["inside"] + top["outside"] == len(want)


def test_rectangles(data):
    rows, df = data
    points = [(r[0], r[3], r[4]) for r in rows if r[3] is not None and r[4] is not None]
    tree = rectangle_tree(df, ["x", "y"], capacity=16, fanout=4)
    assert tree.levels > 2
    inside = sorted(i for i, x, y in points if 5 <= x <= 20 and 7 <= y <= 30)
    assert sorted(r["id"] for r in tree.box([5, 7], [20, 30]).collect()) == inside
    want = sorted((math.dist((x, y), (7.0, 9.0)), i) for i, x, y in points)
    assert sorted(r["id"] for r in tree.ball([7, 9], 5).collect()) == sorted(i for d, i in want if d <= 5)
    assert [r["id"] for r in tree.nearest([7, 9], 30, "id").collect()] == [i for _, i in want[:30]]
    more = tree.insert(df.where("x is not null").withColumn("x", df["x"] + 1000))
    assert sorted(r["id"] for r in more.box([1005, 7], [1020, 30]).collect()) == inside
    assert sorted(r["id"] for r in more.box([5, 7], [20, 30]).collect()) == inside


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    tree = vantage_tree(none, Metric("v", EUCLID), "id")
    assert tree.ball([0.0, 0.0], 9).count() == 0 and tree.nearest([0.0, 0.0], 3).count() == 0 and tree.balance().count() == 0
    boxes = rectangle_tree(none, ["x", "y"])
    assert boxes.box([0, 0], [9, 9]).count() == 0 and boxes.nearest([0, 0], 3, "id").count() == 0


def test_proximity(spark, data):
    """Recall at 10 of a few queries, equal vectors, null vectors, and no rows at all."""
    rows, df = data
    graph = proximity_graph(df, "id", "v", shard=150)
    asked = [[0.1, 0.2], [0.9, 0.4], [0.5, 0.5], [2.0, 2.0]]
    found = graph.nearest(asked, 10).collect()
    for q, v in enumerate(asked):
        want = sorted(math.dist(r[1], v) for r in rows if r[1] is not None)[:10]
        got = sorted(r["dist"] for r in found if r["query_id"] == q)
        assert sum(abs(a - b) < 1e-9 for a, b in zip(got, want)) >= 9
    assert graph.adjacency().count() == sum(r[1] is not None for r in rows)
    assert proximity_graph(spark.createDataFrame([], SCHEMA), "id", "v").nearest(asked, 3).count() == 0


def test_list_weights(data):
    """Lists agree at once for the true weights' direction, and recall does not fall from the even start."""
    from polymetric.plans.weights import aggregate_lists, anchor_pairs, combined, firsts, recall_at

    _, df = data
    metrics = (Metric("v", EUCLID), Metric("x", L1, 40.0))
    pairs = anchor_pairs(df.where("x is not null and id < 400"), metrics, "id", 4)
    assert aggregate_lists(pairs, [2.0, 2.0], k=20, epochs=3).accuracy == 1.0
    from pyspark.sql import functions as F

    true = firsts(pairs, combined([3.0, 0.3], F.col("d")), 20)
    even = recall_at(true, firsts(pairs, combined([0.5, 0.5], F.col("d")), 20))
    got = aggregate_lists(pairs, [3.0, 0.3], k=20, epochs=40, enough=0.0)
    assert got.accuracy > even and got.weights[0] > got.weights[1]


def test_graph_asks_each_row_once(monkeypatch):
    """A row's distances are formed once while a graph is built, and links keep theirs; large shards, which form those of visited rows, get the same links."""
    rng, asked = np.random.default_rng(5), []
    v = rng.normal(size=(300, 8))
    v[200:240] = v[:40]
    far = proximity.Layers.far
    monkeypatch.setattr(proximity.Layers, "far", lambda self, *a: asked.append(1) or far(self, *a))
    graph = proximity.Layers(v).build(4, 20, 1)
    assert len(asked) == 299
    found = [graph.nearest(x, 5, 40) for x in v[:20]]
    assert len(asked) == 319 and all(d == far(graph, x, [j])[0] for x, near in zip(v, found) for d, j in near)
    monkeypatch.setattr(proximity, "ALL", 0)
    other = proximity.Layers(v).build(4, 20, 1)
    assert other.links == graph.links and [other.nearest(x, 5, 40) for x in v[:20]] == found


def test_a_shard_a_task(spark):
    df = spark.range(1200).selectExpr("id", "array(rand(1), rand(2)) AS v")
    plan = proximity.proximity_graph(df, "id", "v", m=4, construction=8, shard=50).links
    assert plan.count() == 1200 and len(plan.inputFiles()) > 4  # before, no more tasks than the session's partitions
