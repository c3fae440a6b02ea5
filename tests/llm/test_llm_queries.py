"""The queries of the training-data operators against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import queries
from siltstone.llm.common import read_table


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, small, same_as_sql):
    same_as_sql(queries.QUERIES[name](spark, small), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs_on_all_rows(name, spark, small):
    df = queries.QUERIES[name](spark, small)
    docs = read_table(spark, small, "documents").where("length(text) > 0").select("doc_id").distinct().count()
    assert df.select("doc_id").distinct().count() >= 0.99 * docs


def test_pipeline(spark, small):
    docs = read_table(spark, small, "documents")
    columns = docs.columns
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= left and len(now) > 0.5 * len(left), name
        left = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.where(F.length("text") > 0).select("doc_id").collect()}
    result = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, packed))
