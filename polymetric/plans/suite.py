"""The registry of queries: a function of (spark, folder) for each, and its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` in tasks of about ``rows`` rows, by a hash of ``key``, however few files or row groups it comes from; as it is if it has no more."""
    n = df.count()
    return df.repartition(-(-n // rows), key) if n > rows else df


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows if there is any."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def statement(name: str, sql: str, spark_sql: str | None = None, tasks: dict[str, tuple[str, int]] | None = None) -> None:
    """Register a statement that Spark runs over views of the tables it names; ``tasks`` has a key and a number of rows a task for tables to deal."""

    def run(spark: SparkSession, sf_dir: str, text: str = spark_sql or sql) -> DataFrame:
        import re

        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                rows = table(spark, sf_dir, t)
                (dealt(rows, *tasks[t]) if tasks and t in tasks else rows).createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name] = run
    SQL[name] = sql
