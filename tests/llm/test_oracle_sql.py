"""Queries that SQL can express, against their DuckDB SQL on whole tables."""

import duckdb
import pytest
from llm_paths import SF01

from reelrank.llm.oracle import ORACLE_SQL
from reelrank.llm.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    got, want = REGISTRY[name](spark, SF01).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)
