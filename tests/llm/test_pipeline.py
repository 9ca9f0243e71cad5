from __future__ import annotations

import os

import pytest

import corpus_pipeline
from noteflow.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(spark, stage(spark, docs, SF), name)
        assert docs.columns == columns
        if name != "mixing":
            assert 0 < docs.count() <= n
            n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_table(spark, name):
    table = {"op1_warc": "pages", "op12_near_vectors": "embeddings"}.get(name, "documents")
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        want = sorted(str(sorted(zip(names, r))) for r in result.fetchall())
        assert want == sorted(str(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, SF).collect())
