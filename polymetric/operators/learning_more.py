"""Transformers and measures whose values SQL can state, and further estimators."""

from __future__ import annotations

import math

from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.ml.evaluation import MultilabelClassificationEvaluator, RankingEvaluator
from pyspark.ml.feature import Binarizer, MaxAbsScaler, Normalizer, OneHotEncoder, VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, IsotonicRegression
from pyspark.sql import functions as F

from ..plans.suite import query, table


def _vectors(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 25).cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(p)


def _spread(df, column: str):
    v = vector_to_array(column)
    return df.select("p_partkey", F.round(v[0], 9).alias("a"), F.round(v[1], 9).alias("b"))


@query("SELECT p_partkey, round((p_size - 25) / CAST(max(abs(p_size - 25)) OVER () AS DOUBLE), 9) AS a, round(p_retailprice / max(abs(p_retailprice)) OVER (), 9) AS b FROM part")
def ml_max_abs(spark, sf):
    v = _vectors(spark, sf)
    return _spread(MaxAbsScaler(inputCol="features", outputCol="scaled").fit(v).transform(v), "scaled")


@query("SELECT p_partkey, round((p_size - 25) / sqrt((p_size - 25) * (p_size - 25) + p_retailprice * p_retailprice), 9) AS a, round(p_retailprice / sqrt((p_size - 25) * (p_size - 25) + p_retailprice * p_retailprice), 9) AS b FROM part")
def ml_normalizer(spark, sf):
    return _spread(Normalizer(inputCol="features", outputCol="unit").transform(_vectors(spark, sf)), "unit")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(1 AS DOUBLE) ELSE 0 END AS large FROM part")
def ml_binarizer(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return Binarizer(threshold=25.0, inputCol="size", outputCol="large").transform(p).select("p_partkey", "large")


@query("SELECT p_partkey, CAST(p_size % 4 = 0 AS DOUBLE) AS is0, CAST(p_size % 4 = 1 AS DOUBLE) AS is1, CAST(p_size % 4 = 2 AS DOUBLE) AS is2 FROM part")
def ml_one_hot(spark, sf):
    """One column less than there are categories."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).cast("double").alias("kind"))
    v = vector_to_array("hot")
    return OneHotEncoder(inputCols=["kind"], outputCols=["hot"]).fit(p).transform(p).select("p_partkey", *[v[i].alias(f"is{i}") for i in range(3)])


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_size % 3) - 1 AS DOUBLE) AS kind FROM part")
def ml_vector_indexer(spark, sf):
    """Few distinct values become category numbers, in their order but that 0 stays 0."""
    p = VectorAssembler(inputCols=["kind"], outputCol="raw").transform(table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 3).cast("double").alias("kind")))
    return VectorIndexer(inputCol="raw", outputCol="indexed", maxCategories=4).fit(p).transform(p).select("p_partkey", vector_to_array("indexed")[0].alias("kind"))


_POINTS = (-500.0, 0.0, 2500.0, 9000.0)


@query(" UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS at, round(avg(exp(-0.5 * ((c_acctbal - ({x})) / 250.0) * ((c_acctbal - ({x})) / 250.0))) / (250.0 * sqrt(2 * pi())), 9) AS density FROM customer" for x in _POINTS))
def kernel_density(spark, sf):
    """Gaussian kernels of one width over a column, at a few points, in one aggregate."""
    c, width = F.col("c_acctbal"), 250.0
    each = [F.round(F.avg(F.exp(-0.5 * ((c - x) / width) * ((c - x) / width))) / (width * math.sqrt(2 * math.pi)), 9).alias(str(i)) for i, x in enumerate(_POINTS)]
    d = table(spark, sf, "customer").agg(*each)
    return d.select(F.explode(F.array(*[F.struct(F.lit(x).alias("at"), F.col(str(i)).alias("density")) for i, x in enumerate(_POINTS)])).alias("p")).select("p.at", "p.density")


def _labels(spark, sf):
    s = F.col("p_size")
    one = table(spark, sf, "part").select((s % 2).cast("double").alias("x"), (s % 3 + 2).cast("double").alias("y"), (s % 4 + 2).cast("double").alias("z"))
    return one.select(F.array("x", "z").alias("prediction"), F.array("x", "y").alias("label"))


_SETS = "WITH s AS (SELECT list_intersect([p_size % 2, p_size % 4 + 2], [p_size % 2, p_size % 3 + 2]) AS hit FROM part), n AS (SELECT len(hit) AS k FROM s)"


@query(f"{_SETS} SELECT round(avg(k / 2.0), 6) AS precision, round(avg(k / 2.0), 6) AS recall, round(avg(k / CAST(4 - k AS DOUBLE)), 6) AS accuracy, round(avg(CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END), 6) AS subset FROM n")
def multilabel_metrics(spark, sf):
    rows, names = _labels(spark, sf), {"precision": "precision", "recall": "recall", "accuracy": "accuracy", "subset": "subsetAccuracy"}
    return spark.createDataFrame([tuple(round(MultilabelClassificationEvaluator(metricName=m).evaluate(rows), 6) for m in names.values())], ", ".join(f"{n} double" for n in names))


@query(f"{_SETS} SELECT round(avg(k / 2.0), 6) AS at2, round(avg(k / 2.0), 6) AS recall2 FROM n")
def ranking_metrics(spark, sf):
    rows = _labels(spark, sf)
    got = [round(RankingEvaluator(metricName=m, k=2).evaluate(rows), 6) for m in ("precisionAtK", "recallAtK")]
    return spark.createDataFrame([tuple(got)], "at2 double, recall2 double")


@query()
def ml_more_models(spark, sf):
    """Error on their own training rows of estimators over the part table."""
    p = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    v = VectorAssembler(inputCols=["size"], outputCol="features").transform(p).withColumn("label", (F.col("size") > 25).cast("double"))
    miss = F.avg((F.col("prediction") != F.col("label")).cast("double"))
    rows = [(type(m).__name__, m.fit(v).transform(v).agg(miss).first()[0]) for m in (LinearSVC(maxIter=10), MultilayerPerceptronClassifier(layers=[1, 4, 2], maxIter=20, seed=1))]
    survival = AFTSurvivalRegression(labelCol="price", censorCol="seen", maxIter=10).fit(v.withColumn("seen", F.lit(1.0)).drop("label"))
    rows.append(("AFTSurvivalRegression", float(survival.scale)))
    order = IsotonicRegression(labelCol="price", featuresCol="size").fit(p)
    rows.append(("IsotonicRegression", order.transform(p).agg(F.avg(F.abs(F.col("prediction") - F.col("price")))).first()[0]))
    return spark.createDataFrame(rows, "name string, value double")


@query()
def ml_power_iteration(spark, sf):
    """Clusters of nations by the trade between them."""
    s = table(spark, sf, "supplier")
    e = s.select(F.col("s_nationkey").cast("long").alias("src"), F.pmod(F.col("s_suppkey") * 7 + 3, F.lit(25)).alias("dst")).where("src <> dst")
    e = e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return PowerIterationClustering(k=2, maxIter=10, weightCol="weight").assignClusters(e)
