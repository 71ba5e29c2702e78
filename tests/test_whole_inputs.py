"""Queries of the reference's own caps and of whole inputs are registered; the cached range is a parameter."""

from testkit import SF001, rows

from reelrank.operators import als, baskets
from reelrank.plans import queries as Q
from reelrank.plans.oracle import ORACLE_SQL
from reelrank.sources import testviews as tv


def test_all_ratings_pass_the_json_sink_and_reader(spark):
    got = Q.REGISTRY["user_recs_json_roundtrip_all"](spark, SF001)
    want = tv.ratings(spark, SF001)
    assert rows(got, "userId", "movieId") == rows(want, "userId", "movieId")
    assert want.filter("rating < 4.5").count() > 0


def test_reference_caps_are_registered_and_an_empty_query_is_not(spark):
    assert (baskets.BASKET_CAP, baskets.BEST_CAP, baskets.RECENT_CAP) == (50, 30, 20)
    assert {"top_per_user_50", "transactions_50", "transactions_best_or_recent_30_20"} <= set(Q.REGISTRY) & set(ORACLE_SQL)
    high = rows(Q._high_titles(spark, SF001), "userId", "movieId")
    assert len(high) > len(rows(Q.REGISTRY["top_per_user"](spark, SF001)))
    assert rows(Q.REGISTRY["top_per_user_50"](spark, SF001), "userId", "movieId") == high  # 50 reaches beyond 10
    assert "search_titles_too_short" not in Q.REGISTRY


def test_cached_range_is_a_parameter(spark):
    users = lambda r: {u for (u,) in Q._tier1_lists(spark, SF001, **r).select("userId").collect()}
    everyone = {u for (u,) in tv.ratings(spark, SF001).select("userId").distinct().collect()}
    assert als.PRECOMPUTE_USERS == (1, 10)
    assert users({}) == {u for u in everyone if 1 <= u <= 10}
    assert users({"user_range": (5, 40)}) == {u for u in everyone if 5 <= u <= 40}
    assert users({"user_range": None}) == everyone
