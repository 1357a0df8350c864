"""Queries whose cost grew too fast, in small: the same rows in the new way, and the parts that bound it."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F


import __spark_entry__  # noqa: F401  (registers all queries)
from polymetric.functions.metrics import Metric
from polymetric.operators import approximate, kernels, learning, relational, searches, similarity, trees
from polymetric.plans import weights
from polymetric.plans.suite import QUERIES

from .conftest import SF


def test_links_of_join(spark, monkeypatch):
    """Links counted by blocks of classes are those of the pairs; copies are not spelled out, and rows without a vector stay."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 60").select("vec_id", "embedding")
    near = e.selectExpr("vec_id + 100", "transform(embedding, (x, i) -> CAST(x + 0.001 * vec_id * (i % 3 - 1) AS float))")
    df = e.union(near).union(e.where("vec_id < 20").selectExpr("vec_id + 200", "embedding"))
    want = Counter(r["left_id"] for r in approximate.lsh_join(df, df, 0.5, "vec_id", "embedding").where("left_id <> right_id").collect())
    monkeypatch.setattr(approximate, "BLOCK", 50)
    none = spark.createDataFrame([(900, None), (901, [float("nan")] * 64)], df.schema)
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in approximate.lsh_links(df.union(none), 0.5, "vec_id", "embedding").collect()}
    assert len(got) == 142 and got[900] == (900, 0) and got[901] == (901, 0)
    assert {k: n for k, (_, n) in got.items() if n} == dict(want) and want
    assert all(got[i + 200][0] == got[i][0] == i for i in range(1, 20))


def test_join_gives_a_row_a_vector(spark):
    got = QUERIES["lsh_similarity_join"](spark, SF)
    assert got.columns == ["vec_id", "class_id", "links"] and got.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


@pytest.fixture(scope="module")
def odd(spark):
    """Equal vectors, ties, other lengths, nulls, huge and infinite components, and a row without a key."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "CAST(slice(embedding, 1, 6) AS array<double>) AS v").where("vec_id < 120")
    more = [(300, None), (301, [1.0]), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, [1e200] * 6), (306, [])]
    return e.union(e.selectExpr("vec_id + 150", "v")).union(e.where("vec_id = 7").selectExpr("CAST(NULL AS long)", "v")).union(spark.createDataFrame(more, e.schema)).selectExpr("*", "v AS w").cache()


@pytest.mark.parametrize("kind", ["l1", "euclid"])
def test_batches_in_tiles(spark, odd, kind, monkeypatch):
    """Tiles give the rows, distances and ties of the plan with an expression a pair."""
    metrics, weights = [Metric("v", kind, 3.0), Metric("w", "l1", 7.0)], [1.0, 0.5]
    asked = odd.where("vec_id % 9 = 0 or vec_id >= 300")
    monkeypatch.setattr(similarity, "BATCH", 10)
    monkeypatch.setattr(similarity, "ROWS", 60)

    def both():
        near = similarity.batch_knn(odd, asked, metrics, weights, 4, "vec_id")
        return [{tuple(r) for r in x.collect()} for x in (near, similarity.batch_range(odd, asked, metrics, weights, 0.07, "vec_id"))]

    plan = similarity.batch_range(odd, asked, metrics, weights, 0.07, "vec_id")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan  # before, an interpreted function a pair
    got = both()
    monkeypatch.setattr(similarity, "_tiled", lambda *_: False)
    assert got == both() and all(got)


def test_slack_of_tiles():
    rng = np.random.default_rng(1)
    for size in (1e-30, 1e-3, 1.0, 1e10):
        a, b = (rng.normal(size=(40, 64)) * size for _ in range(2))
        for kind in ("l1", "euclid"):
            for i, j, d, off in kernels.rough(kind, a, b):
                true = kernels.exact(kind, np.repeat(a, 40, axis=0), np.tile(b, (40, 1))).reshape(40, 40)
                assert np.abs(d - true).max() <= off


def test_tiles_in_whole_numbers(monkeypatch):
    """Sums of absolute gaps are formed in 16 bits, within their error; not where one component makes the steps coarse, nor in wide vectors."""
    rng, kinds = np.random.default_rng(2), []
    plain = kernels.tile
    monkeypatch.setattr(kernels, "tile", lambda kind, a, b: kinds.append(a.dtype.kind) or plain(kind, a, b))
    for size, width, far, said in ((1e-20, 64, 0, "i"), (1.0, 64, 0, "i"), (1e10, 64, 0, "i"), (1.0, 64, 1e6, "f"), (1.0, 2000, 0, "f"), (0.0, 64, 0, "f"), (1.0, 40_000, 0, "f")):
        a, b = (rng.uniform(-size, size, (30, width)) for _ in range(2))
        a[0, 0] += far
        kinds.clear()
        (_, _, d, off), true = *kernels.rough("l1", a, b), np.array([kernels.exact("l1", np.repeat(x[None], 30, axis=0), b) for x in a])
        assert kinds == [said] and d.dtype == np.float32 and np.abs(d - true).max() <= off
        radius = float(np.sort(true, axis=None)[100])
        got = {(r, c): x for rows, columns, near in kernels.within(["l1"], kernels.Scale([1.0], [1.0]), [a], [b], radius) for r, c, x in zip(rows, columns, near)}
        assert got == {(r, c): true[r, c] for r, c in zip(*np.nonzero(true <= radius))}
    ends = np.vstack([np.zeros(64), np.ones(64)])  # the largest sum that there is, in 16 bits
    assert abs(next(kernels.rough("l1", ends, ends))[2][0, 1] - 64) <= 1e-3 and kinds[-1] == "i"


def test_database_of_many_processes(spark, monkeypatch):
    """The database is a file that every process can read, not memory of one."""
    asked = []
    read = type(spark.read).jdbc
    monkeypatch.setattr(type(spark.read), "jdbc", lambda self, url, *a, **k: asked.append(url) or read(self, url, *a, **k))
    got = QUERIES["source_jdbc"](spark, SF)
    assert got.count() == 25 and got.rdd.getNumPartitions() == 2
    assert asked and ":memory:" not in asked[0]


def test_rows_of_a_task(spark, tmp_path, monkeypatch):
    """One row group is dealt to tasks of counted size."""
    monkeypatch.setattr(weights, "ROWS", 60)
    monkeypatch.setattr(learning, "ROWS", 60)
    part = spark.read.parquet(f"{SF}/part.parquet")
    pairs = weights.anchor_pairs(part, searches.PART, "p_partkey", 4)
    assert part.rdd.getNumPartitions() == 1 and pairs.rdd.getNumPartitions() == 4 and pairs.count() == 4 * 199
    assert learning._parts(spark, SF).rdd.getNumPartitions() == 4
    part.crossJoin(spark.range(45)).selectExpr("p_partkey * 45 + id AS p_partkey", *part.columns[1:]).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["fn_xml_columns"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 2 and got.count() == 9000


def test_contrast_deals_no_rows_by_anchor(spark, monkeypatch):
    """The nearest row of every anchor is sent to the rows, not the rows to it."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    pairs, plans = weights.anchor_pairs(part, searches.PART, "p_partkey", 4), []
    cache = type(pairs).cache
    monkeypatch.setattr(type(pairs), "cache", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or cache(self))
    weights.contrast(pairs, [0.6, 0.3, 0.1], epochs=1)
    assert "rightHint=(strategy=broadcast)" in plans[0].split("anchor", 1)[0] + plans[0][:600]


def test_percentiles(spark, monkeypatch):
    """Exact percentiles over several ranges are those of the engine's own aggregate."""
    monkeypatch.setattr(relational, "VALUES", 7)
    df = spark.createDataFrame([(g, v) for g, vs in {"a": [3.0, 1.0, 2.0, 2.0, None, -0.0, 0.0, -5.5], "b": [7.0] * 30 + [8.0], None: [1.0, 4.0], "c": [None], "d": [float("nan"), 1.0, float("inf")], "e": [float(i % 83) / 7 for i in range(400)]}.items() for v in vs], "g string, v double")
    shares = {"p0": 0.0, "p1": 0.13, "p5": 0.5, "p9": 0.9, "p10": 1.0}
    got = relational.exact_percentiles(df, "g", "v", shares)
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()])
    assert {repr(tuple(r)) for r in got.collect()} == {repr(tuple(r)) for r in want.collect()}


def test_rows_go_down_a_tree_in_one_pass(spark):
    """Leaves of vectors as by the distances: nulls, NaN and other lengths too; no join a level."""
    rows = spark.createDataFrame([(0, [0.0], 1), (1, [4.0], 1), (2, [9.0], 1), (3, [1.0, 2.0], 1), (4, [None], 1), (5, [float("nan")], 1), (6, None, 0)], "k long, vantage_at array<double>, leaf int")
    nodes = spark.createDataFrame([(1, [0.0], 5.0), (2, [0.0], 1.0)], "node int, vantage array<double>, reach double")
    got = trees._placed(rows, nodes, Metric("v", "l1"), 2)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert {r["k"]: r["leaf"] for r in got.collect()} == {0: 4, 1: 5, 2: 3, 3: 0, 4: 0, 5: 3, 6: 0}
