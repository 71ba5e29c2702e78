from testkit import rows

from reelrank.operators import baskets as B

SCHEMA = "userId long, movieId long, rating double, timestamp long"


def _items(spark, data):
    return spark.createDataFrame(data, "movieId long, item string")


def test_rank_best_breaks_ties_by_film_id(spark):
    df = spark.createDataFrame([(1, 30, 5.0, 7), (1, 10, 5.0, 7), (1, 20, 5.0, 9)], SCHEMA)
    got = rows(B.rank_best(df), "movieId", "rank_best")
    assert got == [(10, 2), (20, 1), (30, 3)]


def test_rank_recent(spark):
    df = spark.createDataFrame([(1, 30, 1.0, 7), (1, 10, 5.0, 7), (1, 20, 5.0, 9)], SCHEMA)
    assert rows(B.rank_recent(df), "movieId", "rank_recent") == [(10, 2), (20, 1), (30, 3)]


def test_cap_and_window_group_limit(spark):
    df = spark.createDataFrame([(1, m, 4.0, m) for m in range(20)], SCHEMA)
    top = B.top_per_user(df, 5)
    assert top.count() == 5
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_baskets_merge_shared_labels_and_skip_low(spark):
    r = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 4.0, 2), (1, 3, 1.0, 3), (2, 1, 4.0, 1)], SCHEMA)
    items = _items(spark, [(1, "X"), (2, "X"), (3, "Y")])
    got = {u: list(i) for u, i in B.build_baskets(r, items).collect()}
    assert got == {1: ["X"], 2: ["X"]}


def test_best_or_recent_is_union(spark):
    # best by rating: 10, 11; recent by time: 13, 12
    data = [(1, 10, 5.0, 1), (1, 11, 5.0, 2), (1, 12, 4.0, 8), (1, 13, 4.0, 9), (1, 14, 4.0, 3)]
    r = spark.createDataFrame(data, SCHEMA)
    items = _items(spark, [(m, f"t{m}") for m in range(10, 15)])
    tx = B.build_baskets(r, items, mode="best_or_recent", best_cap=2, recent_cap=2)
    assert list(tx.collect()[0]["items"]) == ["t10", "t11", "t12", "t13"]


def test_uncapped(spark):
    r = spark.createDataFrame([(1, m, 4.0, m) for m in range(60)], SCHEMA)
    items = _items(spark, [(m, f"t{m:02d}") for m in range(60)])
    assert len(B.build_baskets(r, items, cap=None).collect()[0]["items"]) == 60
    assert len(B.build_baskets(r, items).collect()[0]["items"]) == 50


def test_distinct_items(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"])], "userId long, items array<string>")
    assert sorted(B.distinct_items(df).collect()[0]["items"]) == ["a", "b"]
