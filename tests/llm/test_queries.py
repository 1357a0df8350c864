"""The production queries and the pipeline over a small table."""

from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from polymetric.llm import jaccard, mixing, packing, pii, quality
from polymetric.llm.common import materialize
from polymetric.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF
from ..oracle import connect, rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLE_SQL[name]).fetchdf()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, SF).collect()) > 0  # a count would let the engine leave columns out


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "mixing", "best-fit packing"]


def test_pipeline_stages(spark):
    """Every stage does to its input what its operator's own result says, and hands on the columns of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, given = [], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = materialize(stage(spark, given, SF), f"test-{k}")
        out.append(given)
    for df in out[:-1]:
        assert df.dtypes == docs.dtypes
    a, b, c, d, e = ([tuple(r) for r in df.collect()] for df in out)
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r[0] for r in a} == kept and len(a) == len(kept)
    links = jaccard.link(out[0]).collect()
    assert {r[0] for r in b} == {r["component_id"] for r in links} and len(b) == len({r[0] for r in b})
    texts = {r[0]: r[1] for r in b}
    spans = {r["doc_id"]: r["spans"] for r in pii.find(out[1]).collect()}
    assert {r[0]: r[1] for r in c} == {i: pii.masked(t, [(pii.KINDS.index(k), int(x), int(y)) for k, x, y in (s.split(":") for s in spans[i].split(",") if s)]) for i, t in texts.items()}
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(out[2]).collect()}
    assert sorted(r[0] for r in d) == sorted(i for i, n in taken.items() for _ in range(n))
    assert len(e) == packing.pieces(out[3]).count()


def test_pipeline_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), f"empty-{k}")
        assert docs.count() == 0
