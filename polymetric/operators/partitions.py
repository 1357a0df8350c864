"""Operators on partitions: pieces of a table as they lie."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..plans.suite import query, table
from .graph import _E, _graph


@query(f"WITH {_E} SELECT src, dst FROM e")
def graph_partition_edges(spark, sf):
    """Edges dealt over a grid of source and destination, so that a vertex meets few parts."""
    e, side = _graph(spark, sf)[1], 3
    return e.repartition(side * side, F.pmod(F.xxhash64("src"), F.lit(side)), F.pmod(F.xxhash64("dst"), F.lit(side)))


@query("SELECT upper(n_name) AS line FROM nation")
def pipe_lines(spark, sf):
    """Lines of each partition through another program."""

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess

        for b in batches:
            done = subprocess.run(["tr", "a-z", "A-Z"], input="\n".join(b["line"]), capture_output=True, text=True, check=True)
            yield pd.DataFrame({"line": done.stdout.split("\n") if len(b) else []})

    return table(spark, sf, "nation").select(F.lower("n_name").alias("line")).mapInPandas(through, "line string")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part")
def partition_totals(spark, sf):
    """Each partition as one row, and their sum."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = total = 0
        for b in batches:
            n, total = n + len(b), total + int(b["p_size"].sum())
        yield pd.DataFrame({"n": [n], "total": [total]})

    parts = table(spark, sf, "part").select("p_size").mapInPandas(one, "n long, total long")
    return parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("SELECT a.p_partkey, a.p_name, b.p_size FROM part a JOIN part b USING (p_partkey)")
def zip_partitions(spark, sf):
    """Two tables put side by side, partition by partition, where both are dealt and sorted alike."""
    p = table(spark, sf, "part")
    left, right = p.select("p_partkey", "p_name"), p.select("p_partkey", "p_size")
    return left.repartition(4, "p_partkey").join(right.repartition(4, "p_partkey").hint("merge"), "p_partkey")
