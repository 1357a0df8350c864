"""Every registered query against its SQL in another engine, or, without SQL, that it runs and keeps its schema."""

from __future__ import annotations

import pytest

import __spark_entry__
from polymetric.plans.suite import QUERIES, SQL

from .conftest import SF
from .oracle import connect, rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = connect(SF).execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    df.collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_sql_names_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
