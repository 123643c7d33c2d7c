"""The registered queries against their SQL, and the others for rows."""

import pytest

from shardloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, same_as_duckdb):
    same_as_duckdb(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", ["op4_lm_scoring", "op5_toxicity", "op6_token_counts", "op9_pii"])
def test_one_row_per_document(name, spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.QUERIES[name](spark, sf).count() == n
