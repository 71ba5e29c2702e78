"""A user holding most of the rows: results stay exact and the plans split
the hot group instead of giving it to one task."""

import pytest
from pyspark.sql import functions as F

from reelrank.operators import baskets, ratings

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _ratings(spark):
    # one computed key column (no constant branch the optimiser could fold):
    # user 7 holds 20,000 of 23,000 rows
    return (spark.range(0, 23000)
            .selectExpr("case when id < 20000 then 7 else id % 300 + 100 end as userId",
                        "id % 500 as movieId",
                        "cast(id % 10 as double) / 2 as rating",
                        "id as timestamp")
            .repartition(8))


def _is_split(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "skew=true" in plan or "isSkew=true" in plan or "AQEShuffleRead skewed" in plan


def test_activity_filter_splits_a_hot_user(spark, skew_conf):
    r = _ratings(spark)
    out = ratings.filter_active(r, min_user=5, min_item=10)
    got = sorted(tuple(x) for x in out.collect())
    # the exact answer, computed without joins
    users = {u for u, c in r.groupBy("userId").count().collect() if c >= 5}
    items = {m for m, c in r.groupBy("movieId").count().collect() if c >= 10}
    want = sorted(tuple(x) for x in r.filter(F.col("userId").isin(list(users))
                                              & F.col("movieId").isin(list(items))).collect())
    assert got == want
    assert _is_split(ratings.filter_active(r, min_user=5, min_item=10))


def test_related_index_splits_a_hot_consequent(spark, skew_conf):
    from reelrank.operators import rules

    found = spark.range(0, 20000).selectExpr("array(concat('a', id)) as antecedent", "array('hot') as consequent", "0.5 as confidence",
                                             "1.0D + id as lift", "0.1 as support").repartition(8)
    labels = spark.range(0, 20000).selectExpr("id as movieId", "concat('a', id) as item").unionByName(
        spark.range(20000, 20001).selectExpr("id as movieId", "'hot' as item")).repartition(8)
    out = rules.related_index(found, labels)
    assert _is_split(out)
    assert out.count() == 20000 and out.filter("items <> array(20000L)").count() == 0


def test_capped_baskets_with_hot_user(spark, skew_conf):
    r = _ratings(spark)
    items = spark.range(0, 500).selectExpr("id as movieId", "concat('t', id) as item")
    top = baskets.top_per_user(r.filter("rating >= 3.5"), 50)
    per_user = {u: c for u, c in top.groupBy("userId").count().collect()}
    assert per_user[7] == 50 and max(per_user.values()) == 50
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    tx = baskets.build_baskets(r, items, cap=50).filter("userId = 7").first()
    assert len(tx["items"]) == 50


def _hot_feed(spark, source):
    # 30,000 users show the same list: its films are hot keys
    return spark.range(0, 30000).selectExpr(
        "id as userId", f"'{source}' as source",
        "case when id >= 0 then array(5L, 6L, 7L) end as items").repartition(8)


def _hot_links(spark):
    return spark.range(0, 100).selectExpr("id as movieId", "cast(id as string) as imdbId",
                                          "cast(id * 7 + 1 as double) as tmdbId")


def test_hot_film_in_feed_resolution_is_split_by_aqe(spark, skew_conf):
    from reelrank.operators.feeds import resolve_feed

    out = resolve_feed(_hot_feed(spark, "als"), _hot_links(spark), "userId")
    assert out.count() == 90000
    assert _is_split(out)


def test_popular_rows_are_resolved_once_and_not_shuffled(spark, skew_conf):
    from reelrank.operators.feeds import resolve_feed

    popular = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "rank int, movieId long")
    feed = _hot_feed(spark, "popular")
    out = resolve_feed(feed, _hot_links(spark), "userId", popular)
    plain = resolve_feed(feed, _hot_links(spark), "userId")
    assert out.exceptAll(plain).count() == 0 and out.count() == 90000
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    own, _, shown = plan.partition("Union")[2].partition("Generate explode")
    assert shown and "Exchange hashpartitioning" not in shown.split("Subquery")[0]
