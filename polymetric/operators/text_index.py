"""Token index over texts: postings as a table, and search among rows that share a token."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least ``least`` letters; all but ASCII letters, digits and underscores parts them."""
    return F.array_distinct(F.transform(F.filter(F.split(c, r"\W+"), lambda w: F.length(w) >= least), F.lower))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``token, <key>``."""
    return df.select(F.explode(tokens(F.col(text))).alias("token"), key)


def shared(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Rows that share a token with the query, with ``n_shared`` and the lower-case edit distance ``dist``.

    One pass without a shuffle: each row's words meet the query's few ones.
    """
    wanted = list(dict.fromkeys(w.lower() for w in re.split(r"\W+", query, flags=re.ASCII) if len(w) >= 3))
    n = F.size(F.array_intersect(tokens(F.col(text)), F.array(*map(F.lit, wanted)).cast("array<string>")))
    hits = df.withColumn("n_shared", n.cast("long")).where(F.col("n_shared") > 0)
    return hits.withColumn("dist", F.levenshtein(F.lower(text), F.lit(query.lower())).cast("double"))


def text_range(df: DataFrame, key: str, text: str, query: str, radius: float) -> DataFrame:
    return shared(df, key, text, query).where(F.col("dist") <= radius)


def text_knn(df: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    return shared(df, key, text, query).orderBy("dist", key).limit(k)
