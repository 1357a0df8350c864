"""Distances of the attributes of a record, and their weighted sum, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L1, EUCLID, TIME, ANGLE, EDIT = "l1", "euclid", "time", "angle", "edit"
#: Numeric codes of metrics in text files and SQL.  Fixed values.
CODES = {0: L1, 1: L1, 2: EUCLID, 3: TIME, 4: L1, 5: ANGLE, 6: EDIT}
#: Query vectors up to this length are written out term by term, which Spark
#: compiles; longer ones go through array functions.
UNROLLED = 128


@dataclass(frozen=True)
class Metric:
    """One attribute: its column, the kind of its distance, and the largest distance, by which it is divided."""

    column: str
    kind: str
    most: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in set(CODES.values()):
            raise ValueError(f"unknown kind of metric: {self.kind}")
        if not self.most > 0:
            raise ValueError(f"the largest distance of {self.column} must be positive")


def _terms(a: Column, b: Any, f) -> Column:
    """Sum of ``f`` over the components of two vectors; ``b`` is a column or numbers."""
    if isinstance(b, Column):
        return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    numbers = [float(x) for x in b]
    if len(numbers) > UNROLLED:
        return _terms(a, F.array(*map(F.lit, numbers)), f)
    total = F.lit(0.0)
    for i, x in enumerate(numbers):
        total = total + f(F.get(a, F.lit(i)).cast("double"), F.lit(x))
    return total


def _vector(c: Any) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def l1(a: Any, b: Any) -> Column:
    return _terms(_vector(a), b, lambda x, y: F.abs(x - y))


def euclid(a: Any, b: Any) -> Column:
    return F.sqrt(_terms(_vector(a), b, lambda x, y: (x - y) * (x - y)))


def angle(a: Any, b: Any) -> Column:
    """Degrees between vectors; null where one of them is zero.  The cosine is held within -1 and 1."""
    a = _vector(a)
    dot = _terms(a, b, lambda x, y: x * y)
    own = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    if isinstance(b, Column):
        other = F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x)
    else:
        other = F.lit(math.fsum(float(x) ** 2 for x in b))
    size = F.sqrt(own) * F.sqrt(other)
    return F.when(size > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size)))))


def time(a: Any, b: Any) -> Column:
    """Seconds between two points in time, either way round."""
    a = F.col(a) if isinstance(a, str) else a
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b if isinstance(b, Column) else F.lit(b).cast("timestamp_ntz"))).cast("double")


def _ints(c: Any) -> Column:
    return (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)).cast("int")


def day_difference(a: Any, b: Any) -> Column:
    """Days between two days written as the number yyyymmdd, either way round; null where one is no day."""
    a, b = (F.try_to_date(F.lpad(_ints(c).cast("string"), 8, "0"), "yyyyMMdd") for c in (a, b))
    return F.abs(F.datediff(a, b)).cast("long")


def second_difference(a: Any, b: Any) -> Column:
    """Seconds between two times of day written as the number hhmmss, either way round."""

    def seconds(c: Any) -> Column:
        n = _ints(c)
        return F.floor(n / 10000) * 3600 + F.floor(n / 100) % 100 * 60 + n % 100

    return F.abs(seconds(a) - seconds(b)).cast("long")


def edit(a: Any, b: Any, within: int | None = None) -> Column:
    """Levenshtein distance; null, if ``within`` is given, where it is larger."""
    a, b = (F.col(a) if isinstance(a, str) else a), (b if isinstance(b, Column) else F.lit(b))
    if within is None:
        return F.levenshtein(a, b).cast("double")
    # The length difference is a lower bound that costs nothing; the function says -1 beyond the threshold.
    d = F.when(F.abs(F.length(a) - F.length(b)) <= within, F.levenshtein(a, b, within))
    return F.when(d >= 0, d).cast("double")


def distance(m: Metric, other: Any, column: Any = None, within: float | None = None) -> Column:
    """Distance of ``m``'s column from ``other``, divided by its largest; ``within`` may cut edit distances short."""
    a = m.column if column is None else column
    if m.kind == L1:
        # Scalars are vectors of one component.
        d = l1(a, other) if not _scalar(other) else F.abs((F.col(a) if isinstance(a, str) else a).cast("double") - other)
    elif m.kind == EUCLID:
        d = euclid(a, other) if not _scalar(other) else F.abs((F.col(a) if isinstance(a, str) else a).cast("double") - other)
    elif m.kind == ANGLE:
        d = angle(a, other)
    elif m.kind == TIME:
        d = time(a, other)
    else:
        d = edit(a, other, None if within is None else math.floor(within * m.most + 1e-9))
    return d / F.lit(float(m.most))


def _scalar(x: Any) -> bool:
    return isinstance(x, (int, float))


def distances(metrics: Sequence[Metric], query: Sequence[Any]) -> Column:
    """All distances from a query record as an array."""
    return F.array(*[distance(m, q) for m, q in zip(metrics, query)])


def checked_weights(metrics: Sequence[Metric], weights: Sequence[float]) -> list[float]:
    if len(weights) != len(metrics):
        raise ValueError(f"{len(weights)} weights for {len(metrics)} metrics")
    if any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must not be negative, and one must be positive")
    return [float(w) for w in weights]


def weighted(metrics: Sequence[Metric], query: Sequence[Any], weights: Sequence[float], within: float | None = None) -> Column:
    """Weighted sum of distances; a metric of weight 0 is not evaluated."""
    total = None
    for m, q, w in zip(metrics, query, checked_weights(metrics, weights)):
        if w:
            term = F.lit(w) * distance(m, q, within=None if within is None else within / w)
            total = term if total is None else total + term
    return total


def spread(df: DataFrame, metric: Metric, pairs: int = 1000, seed: int = 1) -> float:
    """The largest distance among random pairs, a size for ``Metric.most``.

    Two samples are put side by side by rank, so no product of rows is made.
    """
    raw = Metric(metric.column, metric.kind)
    one = df.select(F.col(metric.column).alias("a")).where("a is not null").orderBy(F.rand(seed)).limit(pairs)
    two = df.select(F.col(metric.column).alias("b")).where("b is not null").orderBy(F.rand(seed + 1)).limit(pairs)
    one = one.withColumn("i", F.monotonically_increasing_id())
    two = two.withColumn("i", F.monotonically_increasing_id())
    b = F.col("b")
    if dict(df.dtypes)[metric.column].startswith("array"):
        b = b.cast("array<double>")
    elif metric.kind in (L1, EUCLID):
        return float(one.join(two, "i").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] or 0.0)
    return float(one.join(two, "i").agg(F.max(distance(raw, b, F.col("a")))).first()[0] or 0.0)
