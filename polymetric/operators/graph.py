"""Property graphs as two tables, vertices (``id``) and edges (``src, dst``), and algorithms as joins and aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import application_folder, discard, written
from ..plans.suite import query, table
from .contraction import roots


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration with a table in the shared folder."""
    return written(df, "graph")


def limited(rounds: int | None) -> Iterator[int]:
    """0, 1, .. without end, or an error where the round ``rounds`` would begin."""
    for i in count():
        if i == rounds:
            raise RuntimeError(f"not done after {rounds} rounds")
        yield i


def aggregate_messages(vertices: DataFrame, edges: DataFrame, to_dst: Column | None, to_src: Column | None, merge: Callable[[Column], Column]) -> DataFrame:
    """``id, msg``: messages along edges, merged at their ends; expressions see ``src_<column>`` and ``dst_<column>``."""
    s = vertices.select(*[F.col(c).alias(f"src_{c}") for c in vertices.columns])
    d = vertices.select(*[F.col(c).alias(f"dst_{c}") for c in vertices.columns])
    t = edges.join(s, F.col("src") == F.col("src_id")).join(d, F.col("dst") == F.col("dst_id"))
    parts = [t.select(F.col(end).alias("id"), m.alias("m")) for end, m in (("dst", to_dst), ("src", to_src)) if m is not None]
    sent = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return sent.where(F.col("m").isNotNull()).groupBy("id").agg(merge(F.col("m")).alias("msg"))


def pregel(vertices: DataFrame, edges: DataFrame, message: Column, merge, update: Column, rounds: int | None = None) -> DataFrame:
    """Rounds of messages to destinations and updates of ``value`` (which may use ``msg``), until nothing changes; an error if that takes more than ``rounds``."""
    v = cut(vertices)
    for _ in limited(rounds):
        m = aggregate_messages(v, edges, message, None, merge)
        new = cut(v.join(m, "id", "left").select("id", update.alias("new"), "value"))
        changed = new.where(~F.col("new").eqNullSafe(F.col("value"))).limit(1).count()
        discard(v)
        v = new.select("id", F.col("new").alias("value"))
        if not changed:
            return v


def page_rank(vertices: DataFrame, edges: DataFrame, rounds: int = 10, reset: float = 0.15) -> DataFrame:
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    e = cut(edges.join(out, "src").withColumn("w", 1 / F.col("deg")).select("src", "dst", "w"))
    r = vertices.select("id", F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        got = e.join(r, e["src"] == r["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
        r = cut(vertices.select("id").join(got, F.col("id") == F.col("dst"), "left").select("id", (F.lit(reset) + (1 - reset) * F.coalesce("s", F.lit(0.0))).alias("rank")))
    return r


def connected_components(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id, component``: the least id that edges reach, either way.

    Edges to ids that are no vertices count for nothing.  The graph is
    contracted, which takes few rounds whatever its diameter.  With
    ``rounds``, labels move an edge a round instead, and it is an error if
    they are not still after so many.
    """
    if rounds is not None:
        both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
        v = pregel(vertices.select("id", F.col("id").alias("value")), both, F.col("src_value"), F.min, F.least("value", F.coalesce("msg", "value")), rounds)
        return v.withColumnRenamed("value", "component")
    known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    for end in ("a", "b"):
        known = known.join(vertices.select(F.col("id").alias(end)), end, "left_semi")
    found = cut(roots(known.select("a", "b")))
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    named = found.join(least, "root").select(F.col("node").alias("id"), "least")
    return vertices.select("id").join(named, "id", "left").select("id", F.coalesce("least", "id").alias("component"))


def shortest_paths(vertices: DataFrame, edges: DataFrame, landmark: int, rounds: int | None = None) -> DataFrame:
    """``id, hops`` along edges to ``landmark``; null if there is no way."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = vertices.select("id", F.when(F.col("id") == landmark, 0).cast("int").alias("value"))
    v = pregel(start, back, F.col("src_value") + 1, F.min, F.least("value", "msg"), rounds)
    return v.withColumnRenamed("value", "hops")


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``id, label``: each round the most frequent label of the neighbours, ties to the smaller."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    v = vertices.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        n = both.join(v, both["src"] == v["id"]).groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = n.groupBy("dst").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select(F.col("dst").alias("id"), (-F.col("b.l")).alias("new"))
        v = cut(v.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return v


def triangle_count(edges: DataFrame) -> DataFrame:
    """``id, triangles``.  Edges point from the vertex of smaller degree, so no vertex fans out far."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = e.select(F.col("a").alias("v")).union(e.select("b")).groupBy("v").agg(F.count("*").alias("d"))
    da, db = deg.select(F.col("v").alias("a"), F.col("d").alias("da")), deg.select(F.col("v").alias("b"), F.col("d").alias("db"))
    swap = F.struct("da", "a") <= F.struct("db", "b")
    o = cut(e.join(da, "a").join(db, "b").select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("y")))
    p, q = o.select("x", F.col("y").alias("y1")), o.select("x", F.col("y").alias("y2"))
    wedge = p.join(q, "x").where("y1 <> y2")
    t = wedge.join(o.select(F.col("x").alias("y1"), F.col("y").alias("y2")), ["y1", "y2"])
    return t.select(F.explode(F.array("x", "y1", "y2")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def strongly_connected(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id, component``: the least id from which a vertex can be reached and that it reaches, found by colouring.

    Each pass colours forward by the least id, then goes back from each
    colour's root; what both ways meet is a component and leaves the graph.
    """
    left, e, done = cut(vertices.select("id")), cut(edges.select("src", "dst")), None
    for _ in limited(rounds):
        colour = pregel(left.select("id", F.col("id").alias("value")), e, F.col("src_value"), F.min, F.least("value", F.coalesce("msg", "value")), rounds)
        c = cut(colour.withColumnRenamed("value", "colour"))
        s, d = c.select(F.col("id").alias("src"), F.col("colour").alias("cs")), c.select(F.col("id").alias("dst"), F.col("colour").alias("cd"))
        same = cut(e.join(s, "src").join(d, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = pregel(c.select("id", F.when(F.col("id") == F.col("colour"), 1).otherwise(0).alias("value")), same, F.col("src_value"), F.max, F.greatest("value", F.coalesce("msg", F.lit(0))), rounds)
        found = cut(c.join(back.where("value = 1").select("id"), "id").select("id", F.col("colour").alias("component")))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, "id", "left_anti"))
        if left.isEmpty():
            return done
        e = cut(e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nations as vertices, and supplies between nations as edges."""
    e = _supplies(spark, sf)
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id")), e


def _supplies(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("src"), F.pmod(F.col("s_suppkey") * 7 + 3, F.lit(25)).alias("dst")).where("src <> dst").distinct()


_E = "e AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS src, (s_suppkey * 7 + 3) % 25 AS dst FROM supplier WHERE s_nationkey <> (s_suppkey * 7 + 3) % 25)"


@query(f"WITH {_E} SELECT dst AS id, CAST(count(*) AS BIGINT) AS msg FROM e GROUP BY dst")
def graph_in_degrees(spark, sf):
    v, e = _graph(spark, sf)
    return aggregate_messages(v, e, F.lit(1), None, F.count)


@query(f"WITH {_E} SELECT src AS id, array_to_string(list_sort(list(dst)), ',') AS n FROM e GROUP BY src")
def graph_neighbours(spark, sf):
    _, e = _graph(spark, sf)
    return e.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("n"))


@query(f"WITH RECURSIVE {_E}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(a, b) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation UNION SELECT r.a, u.dst FROM r JOIN u ON r.b = u.src) SELECT a AS id, min(b) AS component FROM r GROUP BY a")
def graph_components(spark, sf):
    return connected_components(*_graph(spark, sf))


@query(f"WITH RECURSIVE {_E}, r(id, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.src, hops + 1 FROM r JOIN e ON e.dst = r.id WHERE hops < 25) SELECT CAST(n_nationkey AS BIGINT) AS id, min(hops) AS hops FROM nation LEFT JOIN r ON id = n_nationkey GROUP BY n_nationkey")
def graph_shortest_paths(spark, sf):
    return shortest_paths(*_graph(spark, sf), landmark=0)


@query(f"WITH {_E}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), t AS (SELECT x.a, x.b, z.b AS c FROM u x JOIN u z ON x.b = z.a JOIN u y ON y.a = x.a AND y.b = z.b) SELECT id, CAST(count(*) AS BIGINT) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) q GROUP BY id")
def graph_triangles(spark, sf):
    return triangle_count(_graph(spark, sf)[1])


@query(f"WITH RECURSIVE {_E}, r(a, b) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src) SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def graph_strong_components(spark, sf):
    return strongly_connected(*_graph(spark, sf))


_PR = f"WITH {_E}, d AS (SELECT src, count(*) AS deg FROM e GROUP BY src), v AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation), r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)"
for _i in range(1, 4):
    _PR += f", r{_i} AS (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(sum(r.rank / d.deg), 0) AS rank FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN r{_i - 1} r ON r.id = e.src LEFT JOIN d ON d.src = e.src GROUP BY v.id)"


@query(_PR + " SELECT id, round(rank, 4) AS rank FROM r3")
def graph_page_rank(spark, sf):
    return page_rank(*_graph(spark, sf), rounds=3).withColumn("rank", F.round("rank", 4))


@query()
def graph_labels(spark, sf):
    return label_propagation(*_graph(spark, sf))


@query(f"WITH {_E} SELECT src, dst FROM e WHERE src < 12 AND dst < 12")
def graph_subgraph(spark, sf):
    v, e = _graph(spark, sf)
    v = v.where("id < 12")
    return e.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")


@query(f"WITH {_E} SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(coalesce(c, 0) AS BIGINT) AS out FROM nation LEFT JOIN (SELECT src, count(*) AS c FROM e GROUP BY src) t ON src = n_nationkey")
def graph_outer_join_vertices(spark, sf):
    """Attributes joined to vertices, with a default where there are none."""
    _, e = _graph(spark, sf)
    v = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    return v.join(out, "id", "left").na.fill(0, ["out"])


@query(f"WITH {_E} SELECT src, dst, a.n_name || '>' || b.n_name AS label FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst")
def graph_map_triplets(spark, sf):
    _, e = _graph(spark, sf)
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("b"))
    return e.join(a, "src").join(b, "dst").select("src", "dst", F.concat_ws(">", "a", "b").alias("label"))


@query(f"WITH {_E} SELECT dst AS src, src AS dst FROM e")
def graph_reverse(spark, sf):
    return _graph(spark, sf)[1].select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@query(f"WITH {_E} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1, 2")
def graph_group_edges(spark, sf):
    """Edges between the same vertices merged, either way."""
    return _graph(spark, sf)[1].groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT src, dst FROM e")
def graph_edge_list_file(spark, sf):
    """Edges written as lines of two ids, with a comment line, and read."""
    path = f"{application_folder(spark)}/edges-{uuid.uuid4().hex}"
    lines = _graph(spark, sf)[1].select(F.concat_ws(" ", "src", "dst").alias("value"))
    lines.union(spark.createDataFrame([("# comment",)], "value string")).write.text(path)
    return spark.read.csv(path, sep=" ", comment="#", schema="src long, dst long")


@query()
def graph_personal_rank(spark, sf):
    """Rank that always starts again at one vertex."""
    v, e = _graph(spark, sf)
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    w = cut(e.join(deg, "src").select("src", "dst", (1 / F.col("deg")).alias("w")))
    start = F.when(F.col("id") == 0, 1.0).otherwise(0.0)
    r = v.select("id", start.alias("rank"))
    for _ in range(5):
        got = w.join(r, w["src"] == r["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
        r = cut(v.join(got, F.col("id") == F.col("dst"), "left").select("id", (0.15 * start + 0.85 * F.coalesce("s", F.lit(0.0))).alias("rank")))
    return r
