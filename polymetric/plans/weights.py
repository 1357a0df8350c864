"""Learning the weights of a multi-metric distance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import Metric, distance
from ..operators.similarity import _prepared
from .suite import dealt

#: Rows of a task that meets all anchors.
ROWS = 16_384


def anchor_pairs(df: DataFrame, metrics: Sequence[Metric], key: str, anchors: int = 16, seed: int = 3) -> DataFrame:
    """``anchor, other, d`` for a bounded number of anchors against all other rows; ``d`` has a distance a metric."""
    data = dealt(_prepared(df, metrics, key, ""), key, ROWS)
    some = _prepared(df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(anchors), metrics, key, "q_")
    both = data.crossJoin(F.broadcast(some)).where(F.col(key) != F.col(f"q_{key}"))
    d = F.array(*[distance(m, F.col(f"q_{m.column}"), F.col(m.column)) for m in metrics])
    return both.select(F.col(f"q_{key}").alias("anchor"), F.col(key).alias("other"), d.alias("d"))


def combined(weights: Sequence[float], d: Column) -> Column:
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.lit(float(w)) * d[i]
    return total


@dataclass
class Learned:
    weights: list[float]
    rmse: float
    accuracy: float


def regress(pairs: DataFrame, truth: Column, n: int, folds: int = 3, near: float = 0.1) -> Learned:
    """Weights whose distance comes nearest to ``truth``: linear regression, with the penalty chosen by folds."""
    rows = pairs.select(*[F.col("d")[i].alias(f"d{i}") for i in range(n)], truth.alias("label"))
    table = VectorAssembler(inputCols=[f"d{i}" for i in range(n)], outputCol="features").transform(rows).select("features", "label").cache()
    model = LinearRegression(fitIntercept=False)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.0, 0.01]).build()
    best = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=folds, seed=1).fit(table).bestModel
    scored = best.transform(table)
    rmse = RegressionEvaluator(metricName="rmse").evaluate(scored)
    share = scored.agg(F.avg((F.abs(F.col("prediction") - F.col("label")) <= near).cast("double"))).first()[0]
    table.unpersist()
    return Learned([float(x) for x in best.coefficients], rmse, share)


def contrast(pairs: DataFrame, truth: Sequence[float], epochs: int = 60, rate: float = 0.5) -> Learned:
    """Weights that put each anchor's true nearest row first.

    Loss: minus the log of e^-d of the positive over that sum of the positive
    and all other rows of the anchor, with its true gradient; one aggregate by
    anchor an epoch, of which a row an anchor is left.
    """
    n = len(truth)
    # A row an anchor; a join dealt by anchor would put all rows of one into one task.
    nearest = pairs.groupBy("anchor").agg(F.min_by(F.struct("other", "d"), F.struct(combined(truth, F.col("d")).alias("t"), "other")).alias("b"))
    rows = pairs.join(F.broadcast(nearest.select("anchor", F.col("b.other").alias("best"))), "anchor").select("anchor", "d", (F.col("other") == F.col("best")).alias("positive")).cache()
    w = [1.0 / n] * n
    loss = 0.0
    for _ in range(epochs):
        e = F.exp(-combined(w, F.col("d")))
        by = rows.groupBy("anchor").agg(F.sum(e).alias("all"), F.sum(F.when(F.col("positive"), e)).alias("e"), *[F.sum(e * F.col("d")[i]).alias(f"a{i}") for i in range(n)], *[F.sum(F.when(F.col("positive"), F.col("d")[i])).alias(f"p{i}") for i in range(n)])
        got = by.agg(F.avg(-F.log(F.col("e") / F.col("all"))).alias("loss"), F.count("*").alias("m"), *[F.sum(F.col(f"p{i}") - F.col(f"a{i}") / F.col("all")).alias(f"g{i}") for i in range(n)]).first()
        if not got["m"]:
            break
        loss = got["loss"]
        w = [max(0.0, x - rate * got[f"g{i}"] / got["m"]) for i, x in enumerate(w)]
    ranked = rows.groupBy("anchor").agg(F.min_by("positive", combined(w, F.col("d"))).alias("positive"))
    first = ranked.agg(F.avg(F.col("positive").cast("double"))).first()[0]
    rows.unpersist()
    return Learned(w, loss, first or 0.0)


def weigh(pairs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``pairs`` with ``weighted``, the distances by their weights, and ``total``, their sum."""
    each = F.transform(F.col("d"), lambda x, i: x * F.element_at(F.array(*[F.lit(float(w)) for w in weights]), i + 1))
    return pairs.withColumn("weighted", each).withColumn("total", combined(weights, F.col("d")))


def firsts(pairs: DataFrame, by: Column, k: int) -> DataFrame:
    """The ``k`` rows of every anchor that come first, with ``rank``; ties to the smaller key."""
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(by, "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def recall_at(true: DataFrame, found: DataFrame) -> float:
    """Share of the pairs of ``true`` that ``found`` has too."""
    n = true.count()
    return true.join(found, ["anchor", "other"], "left_semi").count() / n if n else 1.0


def aggregate_lists(pairs: DataFrame, truth: Sequence[float], k: int = 100, epochs: int = 100, rate: float = 4.0, enough: float = 0.1) -> Learned:
    """Weights whose first ``k`` rows of every anchor are the true first ``k``.

    In an epoch the true row of each rank meets the row that has the rank by
    the current weights; the loss of the two is minus the log of e^-p over
    e^-p + e^-n, with its true gradient, and both are means over all of them.
    Ends when the loss is under ``enough``, when the lists agree, or after
    ``epochs``; the accuracy is the recall of the lists that are returned.
    """
    n = len(truth)
    rows = pairs.cache()
    true = firsts(rows, combined(truth, F.col("d")), k).select("anchor", "rank", "other", F.col("d").alias("p")).cache()
    w, loss, got = [0.5] * n, 0.0, 1.0
    for epoch in range(epochs + 1):
        found = firsts(rows, combined(w, F.col("d")), k).select("anchor", "rank", F.col("other").alias("instead"), F.col("d").alias("n"))
        gap = combined(w, F.col("p")) - combined(w, F.col("n"))
        pull = F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(gap))
        means = true.join(found, ["anchor", "rank"]).agg(F.avg(F.log1p(F.exp(gap))).alias("loss"), *[F.avg(pull * (F.col("p")[i] - F.col("n")[i])).alias(f"g{i}") for i in range(n)], F.every(F.col("other") == F.col("instead")).alias("same")).first()
        loss = means["loss"] or 0.0
        if means["same"] in (None, True) or loss < enough or epoch == epochs:
            got = recall_at(true, found.withColumnRenamed("instead", "other"))
            break
        w = [max(0.0, x - rate * means[f"g{i}"]) for i, x in enumerate(w)]
        if not any(w):
            w = [1.0 / n] * n
    true.unpersist()
    rows.unpersist()
    return Learned(w, loss, got)
