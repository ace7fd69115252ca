"""The registered queries whole: against their SQL twins, and rows and columns of all."""

import os

import duckdb
import pytest

from tessera.llm import queries

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == columns
    key = lambda r: [float(f"{x:.9g}") if isinstance(x, float) else x for x in r]
    want = sorted(repr(key(r)) for r in found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert sorted(repr(key(tuple(r))) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_langid", "op3_simhash", "op4_substring", "op7_sentencepiece", "op8_exact_dedup", "op9_mixing"])
def test_each_document_has_a_row(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())
