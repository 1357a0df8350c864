"""Similarity search by brute force, and the pieces around it."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polymetric.functions.metrics import ANGLE, EDIT, EUCLID, L1, TIME, Metric, checked_weights, distance, spread, weighted
from polymetric.operators.pivots import Catalog
from polymetric.operators.similarity import batch_knn, delete, knn_search, range_search, recall, similarity_join
from polymetric.operators.text_index import text_knn, text_range
from polymetric.plans.sql import Engine, parse_point, split_arguments
from polymetric.plans.tuning import KNOBS, Tuner, knobs_of, reward
from polymetric.plans.weights import anchor_pairs, combined, contrast, regress
from polymetric.sources.formats import read_queries, read_records


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


METRICS = (Metric("v", EUCLID, 10.0), Metric("s", EDIT, 8.0), Metric("x", L1, 100.0))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() * 5, rng.random() * 5], "".join(rng.choices("abc", k=rng.randint(0, 6))), rng.random() * 100) for i in range(300)]
    rows += [(300, None, "a", 1.0), (301, [0.0, 0.0], None, 1.0)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, s string, x double").cache()


def brute(rows, q, w):
    out = []
    for i, v, s, x in rows:
        if v is None or s is None:
            continue
        out.append((w[0] * math.dist(v, q[0]) / 10 + w[1] * levenshtein(s, q[1]) / 8 + w[2] * abs(x - q[2]) / 100, i))
    return sorted(out)


@pytest.mark.parametrize("w", [(1.0, 1.0, 1.0), (2.0, 0.5, 0.0), (0.0, 0.0, 1.0)])
def test_range_and_knn(data, w):
    rows, df = data
    q = [[1.0, 2.0], "abca", 40.0]
    if w[0] == 0:
        rows = [(i, v or [0, 0], s or "", x) for i, v, s, x in rows]
    want = brute(rows, q, w)
    assert sorted(r["id"] for r in range_search(df, METRICS, q, w, 0.5).collect()) == sorted(i for d, i in want if d <= 0.5)
    assert [r["id"] for r in knn_search(df, METRICS, q, w, 12, "id").collect()] == [i for _, i in want[:12]]


def test_index_is_exact(spark, data, tmp_path):
    rows, df = data
    index = Catalog(spark, f"file://{tmp_path}").create("t", df, METRICS, "i", "id", pivots=3, buckets=5)
    for q in ([[1.0, 2.0], "abca", 40.0], [[9.0, 9.0], "", 0.0]):
        want = brute(rows, q, (1.0, 1.0, 1.0))
        assert sorted(r["id"] for r in index.range_search(q, (1, 1, 1), 0.6).collect()) == sorted(i for d, i in want if d <= 0.6)
        assert [r["id"] for r in index.knn_search(q, (1, 1, 1), 9).collect()] == [i for _, i in want[:9]]
    assert index.partition_statistics().first()["buckets"] <= 5


def test_catalog(spark, data, tmp_path):
    _, df = data
    c = Catalog(spark, f"file://{tmp_path}")
    c.create("t", df, METRICS, "i", "id")
    with pytest.warns(UserWarning):
        c.create("t", df, METRICS, "i", "id")
    with pytest.raises(ValueError):
        c.create("t", df, [Metric("none", L1)], "j", "id")
    assert [r["index"] for r in c.show("t").collect()] == ["i"] and c.show("u").count() == 0
    c.drop("t", "i")
    with pytest.raises(KeyError):
        c.drop("t", "i")


def test_batch_and_recall(data):
    rows, df = data
    good = df.na.drop()
    found = batch_knn(good, good.where("id < 5"), METRICS, (1, 1, 1), 4, "id")
    for q in range(5):
        want = [i for _, i in brute(rows, rows[q][1:], (1, 1, 1))[:4]]
        assert [r["id"] for r in found.where(f"query_id = {q}").orderBy("rank").collect()] == want
    assert recall(found, found, ["query_id", "id"]) == 1.0
    assert recall(found.where("rank <= 2"), found, ["query_id", "id"]) == 0.5


def test_similarity_join(spark):
    xs = [(i, float(x)) for i, x in enumerate([0, 0.5, 1, 1.5, 1.5, 7, -0.4])]
    df = spark.createDataFrame(xs, "k long, x double")
    got = {(r["left_id"], r["right_id"]) for r in similarity_join(df, df, Metric("x", L1), 0.5, "k").collect()}
    assert got == {(i, j) for i, x in xs for j, y in xs if abs(x - y) <= 0.5}


def test_weights_are_checked():
    for bad in ([1.0], [0, 0, 0], [-1, 1, 1]):
        with pytest.raises(ValueError):
            checked_weights(METRICS, bad)
    with pytest.raises(ValueError):
        Metric("x", "unknown")


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], "2020-01-01 00:00:00")], "a array<double>, z array<double>, t string").withColumn("t", __import__("pyspark.sql.functions", fromlist=["x"]).col("t").cast("timestamp_ntz"))
    r = df.select(distance(Metric("a", ANGLE), [0.0, 2.0]).alias("a"), distance(Metric("z", ANGLE), [0.0, 2.0]).alias("z"), distance(Metric("a", ANGLE), [2.0, 0.0]).alias("s"), distance(Metric("t", TIME), "2020-01-01 00:01:00").alias("t"), distance(Metric("a", L1), [0.5] * 200).alias("n")).first()
    assert (round(r["a"], 9), r["z"], r["s"], r["t"]) == (90.0, None, 0.0, 60.0)


def test_delete_and_spread(data):
    rows, df = data
    assert delete(df, METRICS[:2], [rows[0][1], rows[0][2]]).count() == len(rows) - 1
    assert 0 < spread(df, Metric("x", L1), 50) <= 100 and spread(df.na.drop(), Metric("v", EUCLID), 50) > 0


def test_sql_front_end(spark, data, tmp_path):
    rows, df = data
    e = Engine(spark, f"file://{tmp_path}")
    e.register("t", df, METRICS, "id")
    want = brute(rows, ([1.0, 2.0], "abca", 40.0), (1, 1, 1))
    for text in ("SELECT id FROM t WHERE t.v IN RANGE(POINT(1,2|abca|40),METRICM(2,6,0),QUERYM(1,1,1),0.5)", "SELECT id FROM t WHERE v IN XRANGE(XPOINT(1,2;'abca';40), (1,1,1), 0.5);"):
        assert sorted(r["id"] for r in e.sql(text).collect()) == sorted(i for d, i in want if d <= 0.5)
    assert [r["id"] for r in e.sql("SELECT id FROM t WHERE EUCLID(v, POINT(1, 2)) KNN 3").collect()] == [i for _, i in sorted((math.dist(v, (1, 2)), i) for i, v, _, _ in rows if v)[:3]]
    assert [r["index"] for r in e.sql("CREATE SOME INDEX i ON t (v, s, x)").collect()] == ["i"]
    assert sorted(r["id"] for r in e.sql("SELECT id FROM t WHERE v IN RANGE(POINT(1,2|abca|40), (1,1,1), 0.5)").collect()) == sorted(i for d, i in want if d <= 0.5)
    assert e.sql("DROP SOME INDEX i ON t").count() == 0 and e.sql("SELECT count(*) AS n FROM t").first()["n"] == len(rows)
    with pytest.raises(ValueError):
        e.sql("CREATE SOME INDEX i ON t (nothing)")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab(),' ", max_size=5).filter(lambda s: s.count("(") == s.count(")") == 0 and "'" not in s and "," not in s), min_size=1, max_size=4))
def test_split_arguments(parts):
    assert split_arguments(",".join(parts)) == [p.strip() for p in parts]


def test_parse_point():
    assert parse_point("POINT(1,2|'a;b'|3)", [L1, EDIT, L1]) == [[1.0, 2.0], "a;b", [3.0]]
    with pytest.raises(ValueError):
        parse_point("POINT(1)", [L1, L1])


def test_text_formats(spark, tmp_path):
    (tmp_path / "d.txt").write_text("2 2\n0 6\n10 4\n1,2 ab\n3,4 b,c\n")
    rows, metrics = read_records(spark, f"file://{tmp_path}/d.txt")
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(3, [1.0, 2.0], "ab"), (4, [3.0, 4.0], "b,c")]
    assert [(m.kind, m.most) for m in metrics] == [(L1, 10.0), (EDIT, 4.0)]
    (tmp_path / "q.txt").write_text("1 2\nx 5 10\n-\n0.1 0.2\n3\n4\n")
    assert read_queries(spark, f"file://{tmp_path}/q.txt") == {"weights": [1.0, 2.0], "ks": [5, 10], "radii": [0.1, 0.2], "ids": [3, 4]}


def test_text_with_punctuation(spark):
    rows = [(1, "Steel, polished"), (2, "(small) tin-plated"), (3, "steelwork of it"), (4, None), (5, "STEEL/steel;tin")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r["id"]: r["n_shared"] for r in text_range(df, "id", "t", "small, tin-steel of", 100).collect()}
    assert got == {1: 1, 2: 2, 5: 2}
    assert [r["id"] for r in text_knn(df, "id", "t", "Steel (polished)", 1).collect()] == [1]


def test_learning_weights(data):
    _, df = data
    good, truth = df.na.drop(), [0.6, 0.1, 0.3]
    pairs = anchor_pairs(good, METRICS, "id", 4).cache()
    import pyspark.sql.functions as F

    got = regress(pairs, combined(truth, F.col("d")), 3)
    assert got.rmse < 0.01 and all(abs(a - b) < 0.05 for a, b in zip(got.weights, truth)) and got.accuracy == 1.0
    assert contrast(pairs, truth, epochs=5).rmse > 0


def test_contrast_sums_all_negatives(data):
    _, df = data
    pairs, truth = anchor_pairs(df.na.drop(), METRICS, "id", 4), [0.6, 0.1, 0.3]
    by = {}
    for r in pairs.collect():
        by.setdefault(r["anchor"], []).append((sum(w * x for w, x in zip(truth, r["d"])), r["other"], list(r["d"])))
    assert min(len(x) for x in by.values()) > 33
    want = sum(sum(min(x)[2]) / 3 + math.log(sum(math.exp(-sum(d) / 3) for _, _, d in x)) for x in by.values()) / len(by)
    assert contrast(pairs, truth, epochs=1).rmse == pytest.approx(want)


def test_tuning():
    t = Tuner(lambda k: (0.0, 1.0 + k["pivots"], 1.0))
    best = t.search(10)
    assert best["pivots"] == min(k["pivots"] for k, _, _ in t.log) and t.change() >= 0
    assert knobs_of([0.0] * len(KNOBS)) == {k: v[0] for k, v in KNOBS.items()}
    assert reward(10, 10, 5) > 0 > reward(10, 10, 20) and reward(10, 5, 8) == 0.0


def test_index_lasts(spark, data, tmp_path):
    """Another catalog of the folder finds an index with what was inserted and deleted; a key that was deleted may come again."""
    rows, df = data
    folder, q = f"file://{tmp_path}", [[1.0, 2.0], "abca", 40.0]
    index = Catalog(spark, folder).create("t", df, METRICS, "i", "id")
    first = next(r for r in rows if r[1] is not None and r[2])
    index.delete([list(first[1]), first[2], first[3]])
    index.insert(df.where(f"id = {rows[5][0]}").withColumn("id", df["id"] + 1000))
    again = Catalog(spark, folder).get("t", "i")
    changed = [r for r in rows if r != first] + [(rows[5][0] + 1000, *rows[5][1:])]
    want = [i for _, i in brute(changed, q, (1.0, 1.0, 1.0))]
    assert [r["id"] for r in again.knn_search(q, (1, 1, 1), len(changed)).collect()] == want
    again.insert(df.where(f"id = {first[0]}"))
    assert Catalog(spark, folder).get("t", "i").table.count() == len(rows) + 1
    assert Catalog(spark, folder).ensure("t", df, METRICS, "id").name == "i"
    Catalog(spark, folder).drop("t", "i")
    assert not Catalog(spark, folder).found


def test_sql_predicates_anywhere(spark, data, tmp_path):
    rows, df = data
    e = Engine(spark, f"file://{tmp_path}")
    e.register("t", df, METRICS, "id")
    far = dict((i, d) for d, i in brute(rows, ([1.0, 2.0], "abca", 40.0), (1, 1, 1)))
    at = "POINT(1,2|abca|40), (1,1,1)"
    got = e.sql(f"SELECT a.id, b.x FROM t AS a JOIN t b ON a.id = b.id WHERE a.v IN RANGE({at}, 0.8) AND b.x > 50 OR a.s = 'IN RANGE(' ORDER BY a.id LIMIT 5").collect()
    assert [r["id"] for r in got] == sorted(i for i, _, _, x in rows if far.get(i, 9) <= 0.8 and x > 50)[:5]
    got = e.sql("SELECT count(*) AS n FROM t WHERE EUCLID(v, POINT(1, 2)) KNN 7 AND id >= 0").first()["n"]
    assert got == 7
    with pytest.raises(ValueError):
        e.sql(f"SELECT 1 FROM t WHERE nothing IN RANGE({at}, 0.8) AND true")
