"""Queries that have to read whole tables, against SQL without any cut or by brute force."""

from __future__ import annotations

import pytest

import __spark_entry__  # noqa: F401  (registers all queries)
from polymetric.operators import graph
from polymetric.plans.suite import QUERIES, SQL

from .oracle import connect, rows

#: At this size the tables have more rows than any id that the registered SQL stops at.
LARGER = "/root/testdata/sf0.01"
SUPPLIERS = " s_suppkey <= 60 AND"


@pytest.mark.parametrize("name", sorted(n for n in SQL if n.startswith("graph_")))
def test_graph_of_all_suppliers(spark, name):
    sql = SQL[name].replace(SUPPLIERS, "")
    assert rows(QUERIES[name](spark, LARGER).toPandas()) == rows(connect(LARGER).execute(sql).fetchdf())


def test_edges_of_all_suppliers(spark):
    """What the graph queries without SQL read."""
    keys = connect(LARGER).execute("SELECT s_suppkey, s_nationkey FROM supplier").fetchall()
    want = {(n, (k * 7 + 3) % 25) for k, n in keys if n != (k * 7 + 3) % 25}
    got = graph._graph(spark, LARGER)[1].collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def chain(spark, n, closed=False):
    """Vertices 0 to n - 1 and an edge from each to the next, and from the last to the first if closed."""
    v = spark.range(n)
    return v.coalesce(1), v.where("true" if closed else f"id < {n - 1}").selectExpr("id AS src", f"(id + 1) % {n} AS dst").coalesce(1)


def test_long_ways(spark):
    v, e = chain(spark, 104)
    assert {tuple(r) for r in graph.connected_components(v, e).collect()} == {(i, 0) for i in range(104)}
    assert {tuple(r) for r in graph.shortest_paths(v, e, 103).collect()} == {(i, 103 - i) for i in range(104)}


def test_long_cycle(spark):
    assert {tuple(r) for r in graph.strongly_connected(*chain(spark, 53, closed=True)).collect()} == {(i, 0) for i in range(53)}


def test_limit_of_rounds(spark):
    with pytest.raises(RuntimeError):
        graph.connected_components(*chain(spark, 6), rounds=3)


def test_libsvm_of_all_parts(spark):
    sql = "SELECT CAST(p_size AS DOUBLE) AS label, round(p_retailprice, 2) AS v FROM part"
    assert rows(QUERIES["source_libsvm"](spark, LARGER).toPandas()) == rows(connect(LARGER).execute(sql).fetchdf())


def test_intersect_all_customers(spark):
    sql = "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT c_nationkey FROM customer"
    assert rows(QUERIES["intersect_all"](spark, LARGER).toPandas()) == rows(connect(LARGER).execute(sql).fetchdf())
