"""Plan-shape checks over every registered query: the properties the design
relies on at scale, read from the executed physical plan."""

import pytest
from testkit import SF001

from reelrank.plans import queries as Q

# It holds our lists against Spark ML's own scoring, which multiplies user and item factor blocks.
ALS_SCORING = {"als_lists_verified"}
WRITES = {"csv_roundtrip", "user_recs_json_roundtrip", "popular_json_roundtrip"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q.REGISTRY) - ALS_SCORING - WRITES))
def test_no_cartesian_products(spark, name):
    plan = _plan(Q.REGISTRY[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDFs


def test_filters_and_columns_reach_the_scan(spark):
    from reelrank.operators.ratings import high_rated

    df = spark.read.parquet(f"{SF001}/lineitem.parquet").selectExpr(
        "l_orderkey as userId", "l_partkey as movieId", "l_quantity / 10 as rating", "0L as timestamp")
    plan = _plan(high_rated(df.filter("l_quantity >= 35")).select("movieId"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,35.0)" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan


def test_top_k_per_group_is_limited_before_shuffle(spark):
    plan = _plan(Q.REGISTRY["top_per_user"](spark, SF001))
    assert plan.count("WindowGroupLimit") >= 2  # partial before the exchange, final after
