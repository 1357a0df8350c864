"""Components of an undirected graph by contraction, in rounds that grow with the logarithm of its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written


def rank(name: str):
    """A fixed order of nodes that has nothing to do with their numbers, so that no way is long in it."""
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("p"))


def roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of undirected ``a, b``: one root a component.

    Every node points to the first of its neighbours and itself in a hashed
    order, two pointers are followed at once, and edges are drawn again
    between what nodes point to, until none is left.  In that order a way of
    a hundred thousand nodes takes about ten rounds, however it is numbered.
    Loops and edges with a null end say nothing.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    levels: list[DataFrame] = []
    while not e.isEmpty():
        sym = e.select("a", "b").union(e.select("b", "a"))
        best = sym.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("m"))
        up = written(best.select("v", F.least(rank("v"), "m")["p"].alias("p")), "parents")
        over = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
        top = written(up.join(over, "p").select("v", F.col("q").alias("p")), "grandparents")
        a, b = top.select(F.col("v").alias("a"), F.col("p").alias("pa")), top.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        drawn = e.join(a, "a").join(b, "b").where("pa <> pb")
        left = written(drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(e, up)
        levels.append(top)
        e = left
    if not levels:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # The last levels are small: they are put together first.
    found = levels[-1]
    for i, level in enumerate(reversed(levels[:-1]), 1):
        then = found.select(F.col("v").alias("p"), F.col("p").alias("q"))
        found = level.join(then, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        if i % 4 == 0:
            found = written(found, "roots")
    return found.select(F.col("v").alias("node"), F.col("p").alias("root"))
