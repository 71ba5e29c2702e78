"""Every registered query against its DuckDB oracle at sf0.01 (the external
correctness check), compared by row count, column names and sorted values."""

import math

import duckdb
import pandas as pd
import pytest
from testkit import SF01

import __spark_entry__ as E
from reelrank.plans.oracle import ORACLE_SQL
from reelrank.plans.queries import NO_ORACLE, REGISTRY

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    got = _rows(REGISTRY[name](spark, SF01).toPandas())
    want = _rows(con.sql(ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["rank", "movieId", "tmdbId", "count", "avg_rating"]


def test_every_query_has_oracle_or_is_model_backed():
    assert set(REGISTRY) - set(ORACLE_SQL) == NO_ORACLE
    assert set(REGISTRY) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())
