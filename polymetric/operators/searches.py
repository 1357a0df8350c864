"""Similarity searches as queries."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions.metrics import ANGLE, EDIT, EUCLID, L1, TIME, Metric, distances
from ..plans.sql import Engine
from ..plans.storage import application_folder
from ..plans.suite import query, table
from . import approximate, pivots, text_index
from .similarity import batch_knn, batch_range, delete, insert, knn_search, range_search, similarity_join

E = table
#: A fixed query vector, so that Spark and SQL search for the same.
VECTOR = [round(0.02 * ((i * 7) % 13 - 6), 2) for i in range(64)]
_V = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
_L1 = "list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), {v}), lambda p: abs(p[1] - p[2])))"
_L2 = "sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), {v}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_ANG = "degrees(acos(greatest(-1.0, least(1.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {v})))))"
TWO = (Metric("embedding", L1, 10.0), Metric("embedding", ANGLE, 180.0))
PART = (Metric("p_name", EDIT, 20.0), Metric("p_size", L1, 50.0), Metric("p_retailprice", L1, 2000.0))
PART_POINT, PART_WEIGHTS = ["part 7", 20, 1000.0], [1.0, 0.5, 2.0]
_PART = "(levenshtein(p_name, 'part 7') / 20.0 + 0.5 * abs(p_size - 20) / 50.0 + 2.0 * abs(p_retailprice - 1000.0) / 2000.0)"


def _folder(spark, sf: str = "") -> str:
    """A folder of indexes for the tables of ``sf``, or one of its own; it goes with the application."""
    name = hashlib.md5(sf.encode()).hexdigest() if sf else uuid.uuid4().hex
    return f"{application_folder(spark)}/indexes-{name}"


@query(f"SELECT vec_id, round(d, 6) AS dist FROM (SELECT vec_id, {_L1.format(v=_V)} / 10 + 2 * {_ANG.format(v=_V)} / 180 AS d FROM embeddings) t ORDER BY d, vec_id LIMIT 10")
def weighted_knn(spark, sf):
    found = knn_search(E(spark, sf, "embeddings"), TWO, [VECTOR, VECTOR], [1.0, 2.0], 10, "vec_id")
    return found.select("vec_id", F.round("dist", 6).alias("dist"))


@query(f"SELECT vec_id, round({_L2.format(v=_V)}, 6) AS dist FROM embeddings WHERE {_L2.format(v=_V)} <= 1.1")
def euclid_range(spark, sf):
    return range_search(E(spark, sf, "embeddings"), [Metric("embedding", EUCLID)], [VECTOR], [1.0], 1.1).select("vec_id", F.round("dist", 6).alias("dist"))


@query(f"SELECT vec_id, round({_L1.format(v=_V)}, 6) AS l1, round({_ANG.format(v=_V)} / 180, 6) AS ang FROM embeddings")
def distance_vector(spark, sf):
    d = distances([Metric("embedding", L1), Metric("embedding", ANGLE, 180.0)], [VECTOR, VECTOR])
    return E(spark, sf, "embeddings").withColumn("d", d).select("vec_id", F.round(F.col("d")[0], 6).alias("l1"), F.round(F.col("d")[1], 6).alias("ang"))


@query(f"SELECT p_partkey, round({_PART}, 6) AS dist FROM part WHERE {_PART} <= 0.6")
def mixed_range(spark, sf):
    return range_search(E(spark, sf, "part"), PART, PART_POINT, PART_WEIGHTS, 0.6).select("p_partkey", F.round("dist", 6).alias("dist"))


@query(f"SELECT p_partkey, round({_PART}, 6) AS dist FROM part ORDER BY {_PART}, p_partkey LIMIT 15")
def mixed_knn(spark, sf):
    return knn_search(E(spark, sf, "part"), PART, PART_POINT, PART_WEIGHTS, 15, "p_partkey").select("p_partkey", F.round("dist", 6).alias("dist"))


@query("SELECT event_id, round(abs(epoch(ts) - epoch(TIMESTAMP '2024-01-05 00:00:00')) / 86400.0 + abs(value - 10.0) / 100.0, 6) AS dist FROM (SELECT event_id, date_trunc('second', ts) AS ts, value FROM events) e ORDER BY abs(epoch(ts) - epoch(TIMESTAMP '2024-01-05 00:00:00')) / 86400.0 + abs(value - 10.0) / 100.0, event_id LIMIT 20")
def time_knn(spark, sf):
    metrics = [Metric("ts", TIME, 86400.0), Metric("value", L1, 100.0)]
    return knn_search(E(spark, sf, "events"), metrics, ["2024-01-05 00:00:00", 10.0], [1.0, 1.0], 20, "event_id").select("event_id", F.round("dist", 6).alias("dist"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, 'part 42') AS DOUBLE) AS dist FROM part WHERE levenshtein(p_name, 'part 42') <= 3")
def edit_range(spark, sf):
    return range_search(E(spark, sf, "part"), [Metric("p_name", EDIT)], ["part 42"], [1.0], 3).select("p_partkey", "dist")


_PAIR = "list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda p: abs(p[1] - p[2])))"


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round({_PAIR}, 6) AS dist FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND {_PAIR} <= 6.5")
def batch_range_search(spark, sf):
    e = E(spark, sf, "embeddings")
    return batch_range(e, e.where("vec_id % 50 = 0"), [Metric("embedding", L1)], [1.0], 6.5, "vec_id").withColumn("dist", F.round("dist", 6))


@query(f"SELECT * FROM (SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_PAIR}, e.vec_id) AS INT) AS rank, e.vec_id FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) t WHERE rank <= 5")
def batch_knn_search(spark, sf):
    e = E(spark, sf, "embeddings")
    return batch_knn(e, e.where("vec_id % 50 = 0"), [Metric("embedding", L1)], [1.0], 5, "vec_id").select("query_id", "rank", "vec_id")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM supplier a, supplier b WHERE abs(a.s_acctbal - b.s_acctbal) / 100.0 <= 0.05")
def similarity_join_count(spark, sf):
    s = E(spark, sf, "supplier")
    return similarity_join(s, s, Metric("s_acctbal", L1, 100.0), 0.05, "s_suppkey").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, round({_PART}, 6) AS dist FROM part WHERE {_PART} <= 0.6")
def indexed_range(spark, sf):
    index = pivots.Catalog(spark, _folder(spark, sf)).ensure("part", E(spark, sf, "part"), PART, "p_partkey")
    return index.range_search(PART_POINT, PART_WEIGHTS, 0.6).select("p_partkey", F.round("dist", 6).alias("dist"))


@query(f"SELECT p_partkey, round({_PART}, 6) AS dist FROM part ORDER BY {_PART}, p_partkey LIMIT 15")
def indexed_knn(spark, sf):
    index = pivots.Catalog(spark, _folder(spark, sf)).ensure("part", E(spark, sf, "part"), PART, "p_partkey")
    return index.knn_search(PART_POINT, PART_WEIGHTS, 15).select("p_partkey", F.round("dist", 6).alias("dist"))


@query()
def index_statistics(spark, sf):
    return pivots.Catalog(spark, _folder(spark, sf)).ensure("part", E(spark, sf, "part"), PART, "p_partkey").partition_statistics()


@query("SELECT 'second' AS \"index\"")
def index_catalog(spark, sf):
    """Create, show and drop."""
    catalog = pivots.Catalog(spark, _folder(spark))
    part = E(spark, sf, "part")
    for name in ("first", "second"):
        catalog.create("part", part, PART[1:], name, "p_partkey")
    catalog.drop("part", "first")
    return catalog.show("part")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size <> 20")
def delete_points(spark, sf):
    p = E(spark, sf, "part")
    return delete(p, [Metric("p_size", L1)], [20]).agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) + 1 AS BIGINT) AS n, max(p_partkey) + 1 AS most FROM part")
def insert_points(spark, sf):
    p = E(spark, sf, "part")
    new = p.orderBy(F.desc("p_partkey")).limit(1).withColumn("p_partkey", F.col("p_partkey") + 1)
    return insert(p, new).agg(F.count("*").alias("n"), F.max("p_partkey").alias("most"))


_FIRST = "(SELECT {c} FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part WHERE p_size = 20))"
_LEFT = " OR ".join(f"{c} <> {_FIRST.format(c=c)}" for c in ("p_name", "p_size", "p_retailprice"))


@query(f"SELECT p_partkey, round({_PART}, 6) AS dist FROM (SELECT p_partkey, p_name, p_size, p_retailprice FROM part UNION ALL SELECT -p_partkey - 1, p_name, p_size, p_retailprice FROM part WHERE p_size = 20) t WHERE {_PART} <= 0.6 AND ({_LEFT})")
def indexed_changes(spark, sf):
    """Insert and delete through an index, which another catalog then reads from its folder."""
    folder, part = _folder(spark), E(spark, sf, "part")
    index = pivots.Catalog(spark, folder).create("part", part, PART, "changed", "p_partkey")
    index.insert(part.where("p_size = 20").withColumn("p_partkey", -F.col("p_partkey") - 1))
    first = part.where("p_size = 20").orderBy("p_partkey").first()
    index.delete([first["p_name"], float(first["p_size"]), first["p_retailprice"]])
    again = pivots.Catalog(spark, folder).get("part", "changed")
    return again.range_search(PART_POINT, PART_WEIGHTS, 0.6).select("p_partkey", F.round("dist", 6).alias("dist"))


_TOK = "len(list_intersect(list_distinct(string_split_regex(lower(p_type), '\\s+')), ['small', 'brushed', 'steel']))"


@query(f"SELECT p_partkey, CAST({_TOK} AS BIGINT) AS n_shared, CAST(levenshtein(lower(p_type), 'small brushed steel') AS DOUBLE) AS dist FROM part WHERE {_TOK} > 0 AND levenshtein(lower(p_type), 'small brushed steel') <= 9")
def token_range(spark, sf):
    return text_index.text_range(E(spark, sf, "part"), "p_partkey", "p_type", "SMALL BRUSHED STEEL", 9).select("p_partkey", "n_shared", "dist")


@query(f"SELECT p_partkey FROM part WHERE {_TOK} > 0 ORDER BY levenshtein(lower(p_type), 'small brushed steel'), p_partkey LIMIT 10")
def token_knn(spark, sf):
    return text_index.text_knn(E(spark, sf, "part"), "p_partkey", "p_type", "SMALL BRUSHED STEEL", 10).select("p_partkey")


@query()
def lsh_knn(spark, sf):
    """Approximate neighbours by random projections; an estimate, so no SQL."""
    return approximate.lsh_knn(E(spark, sf, "embeddings"), VECTOR, 10, "vec_id", "embedding")


def _engine(spark, sf) -> Engine:
    engine = Engine(spark, _folder(spark))
    engine.register("parts", E(spark, sf, "part"), PART, "p_partkey")
    engine.register("vectors", E(spark, sf, "embeddings"), [Metric("embedding", EUCLID)], "vec_id")
    return engine


@query(f"SELECT p_partkey, round({_PART}, 6) AS dist FROM part WHERE {_PART} <= 0.6")
def sql_range(spark, sf):
    return _engine(spark, sf).sql("SELECT p_partkey, round(dist, 6) AS dist FROM parts WHERE parts.p_name IN RANGE(POINT('part 7'|20|1000.0),METRICM(6,0,0),QUERYM(1,0.5,2),0.6)")


@query(f"SELECT p_partkey FROM part ORDER BY {_PART}, p_partkey LIMIT 15")
def sql_knn(spark, sf):
    return _engine(spark, sf).sql("SELECT p_partkey FROM parts WHERE parts.p_name IN KNN(POINT('part 7';20;1000.0), (1,0.5,2), 15)")


@query(f"SELECT vec_id FROM embeddings ORDER BY {_L2.format(v=_V)}, vec_id LIMIT 7")
def sql_single_knn(spark, sf):
    return _engine(spark, sf).sql(f"SELECT vec_id FROM vectors WHERE EUCLID(embedding, POINT({','.join(map(str, VECTOR))})) KNN 7")


@query(f"SELECT vec_id FROM embeddings WHERE {_L2.format(v=_V)} <= 1.1")
def sql_single_range(spark, sf):
    return _engine(spark, sf).sql(f"SELECT vec_id FROM vectors WHERE embedding IN RANGE(POINT({','.join(map(str, VECTOR))}), 1.1)")


@query(f"SELECT p_partkey, round({_PART}, 6) AS dist FROM part ORDER BY {_PART}, p_partkey LIMIT 15")
def sql_indexed_knn(spark, sf):
    """Index statements, then a search that uses the index."""
    engine = _engine(spark, sf)
    engine.sql("CREATE PIVOT INDEX by_all ON parts (p_name, p_size, p_retailprice)")
    found = engine.sql("SELECT p_partkey, round(dist, 6) AS dist FROM parts WHERE p_name IN KNN(POINT('part 7'|20|1000.0), QUERYM(1,0.5,2), 15)")
    assert engine.sql("SHOW PIVOT INDEXES").count() == 1
    engine.sql("CREATE PIVOT INDEX unused ON parts (p_size)")
    engine.sql("DROP PIVOT INDEX unused ON parts")
    return found


_AT = "POINT('part 7'|20|1000.0),METRICM(6,0,0),QUERYM(1,0.5,2)"


@query(f"SELECT p_brand, count(*) AS n, round(avg({_PART}), 6) AS mean FROM part WHERE {_PART} <= 0.9 AND p_size < 30 GROUP BY p_brand")
def sql_range_grouped(spark, sf):
    """A similarity predicate beside another one, under an aggregate."""
    return _engine(spark, sf).sql(f"SELECT p_brand, count(*) AS n, round(avg(dist), 6) AS mean FROM parts WHERE p_name IN RANGE({_AT},0.9) AND p_size < 30 GROUP BY p_brand")


@query(f"SELECT p.p_partkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM (SELECT p_partkey FROM part ORDER BY {_PART}, p_partkey LIMIT 15) p JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey")
def sql_knn_join(spark, sf):
    """The nearest rows of a table, joined with another one."""
    E(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return _engine(spark, sf).sql(f"SELECT p.p_partkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM parts p JOIN lineitem l ON l.l_partkey = p.p_partkey WHERE p.p_name IN KNN({_AT},15) GROUP BY p.p_partkey")


@query(f"SELECT p_partkey FROM part WHERE NOT ({_PART} <= 0.9) AND p_size = 20 OR p_partkey IN (SELECT p_partkey FROM part WHERE {_PART} <= 0.6)")
def sql_range_negated(spark, sf):
    """Predicates under NOT and OR and in a subquery."""
    return _engine(spark, sf).sql(f"SELECT p_partkey FROM parts a WHERE a.p_name NOT IN RANGE({_AT},0.9) AND p_size = 20 OR p_partkey IN (SELECT b.p_partkey FROM parts b WHERE b.p_name IN RANGE({_AT},0.6))")


@query()
def metric_spread(spark, sf):
    """Largest distance of a thousand random pairs, a size for a metric; an estimate."""
    from ..functions.metrics import spread

    return spark.createDataFrame([(spread(E(spark, sf, "part"), Metric("p_retailprice", L1)),)], "most double")


@query()
def learned_weights(spark, sf):
    """Weights found by regression on the distance vectors of anchor pairs; rows are weights, error and accuracy."""
    from ..plans.weights import anchor_pairs, combined, regress

    truth = [0.6, 0.3, 0.1]
    got = regress(anchor_pairs(E(spark, sf, "part"), PART, "p_partkey", 4), combined(truth, F.col("d")), 3)
    return spark.createDataFrame([(i, t, float(w), got.rmse, got.accuracy) for i, (t, w) in enumerate(zip(truth, got.weights))], "metric int, truth double, weight double, rmse double, accuracy double")


@query()
def contrastive_weights(spark, sf):
    from ..plans.weights import anchor_pairs, contrast

    got = contrast(anchor_pairs(E(spark, sf, "part"), PART, "p_partkey", 8), [0.6, 0.3, 0.1], epochs=10)
    return spark.createDataFrame([(i, float(w), got.accuracy) for i, w in enumerate(got.weights)], "metric int, weight double, first double")



@query()
def list_weights(spark, sf):
    """Weights by the lists of the first hundred rows; rows are weights, loss and recall."""
    from ..plans.weights import aggregate_lists, anchor_pairs

    got = aggregate_lists(anchor_pairs(E(spark, sf, "part"), PART, "p_partkey", 4), [0.6, 0.3, 0.1], epochs=10)
    return spark.createDataFrame([(i, float(w), got.rmse, got.accuracy) for i, w in enumerate(got.weights)], "metric int, weight double, loss double, recall double")


@query(f"SELECT p_partkey, round(0.5 * levenshtein(p_name, 'part 7') / 20.0, 6) AS name, round(0.5 * abs(p_size - 20) / 50.0, 6) AS size, round(0.5 * levenshtein(p_name, 'part 7') / 20.0 + 0.5 * abs(p_size - 20) / 50.0, 6) AS total FROM part")
def weigh_distances(spark, sf):
    """Distances by their weights, one by one and together."""
    from ..plans.weights import weigh

    rows = weigh(E(spark, sf, "part").withColumn("d", distances(PART[:2], PART_POINT[:2])), [0.5, 0.5])
    return rows.select("p_partkey", F.round(F.col("weighted")[0], 6).alias("name"), F.round(F.col("weighted")[1], 6).alias("size"), F.round("total", 6).alias("total"))
