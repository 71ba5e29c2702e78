from testkit import rows

from reelrank.operators import ratings as R

SCHEMA = "userId long, movieId long, rating double, timestamp long"


def test_filter_active_is_one_pass(spark):
    # user 1 has 3 ratings, but one is of film 30 (only one rating): after the
    # film is removed user 1 keeps 2 rows although min_user is 3.
    data = [(1, 10, 4.0, 1), (1, 20, 3.0, 2), (1, 30, 5.0, 3),
            (2, 10, 4.0, 1), (2, 20, 2.0, 2), (2, 40, 1.0, 3),
            (3, 10, 4.0, 1), (3, 20, 2.0, 2), (3, 40, 1.0, 3),
            (4, 10, 1.0, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    out = R.filter_active(df, min_user=3, min_item=2)
    assert out.columns == ["userId", "movieId", "rating", "timestamp"]
    got = rows(out, "userId", "movieId")
    assert (1, 10) in got and (1, 20) in got and (1, 30) not in got
    assert all(u != 4 for u, _ in got)


def test_counts_count_null_ratings(spark):
    df = spark.createDataFrame([(1, 10, None, 1), (1, 11, 3.0, 1)], SCHEMA)
    assert rows(R.user_rating_counts(df)) == [(1, 2)]


def test_rating_stats_skip_nulls(spark):
    df = spark.createDataFrame(
        [(1, 10, None, 1), (2, 10, 3.0, 1), (3, 10, 5.0, 1), (4, None, 5.0, 1)], SCHEMA)
    assert rows(R.rating_stats(df)) == [(10, 2, 4.0)]


def test_high_rated_threshold(spark):
    df = spark.createDataFrame([(1, 10, 3.5, 1), (1, 11, 3.0, 1)], SCHEMA)
    assert rows(R.high_rated(df), "movieId") == [(10,)]


def test_movies_with_min_votes(spark):
    r = spark.createDataFrame([(u, 10, 4.0, 1) for u in range(3)] + [(1, 11, 4.0, 1)], SCHEMA)
    m = spark.createDataFrame([(10, "a", "g"), (11, "b", "g")], "movieId long, title string, genres string")
    assert rows(R.movies_with_min_votes(m, r, 3)) == [(10, "a", "g", 3)]


def test_empty_input_keeps_schema(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = R.filter_active(df)
    assert out.count() == 0 and out.columns == ["userId", "movieId", "rating", "timestamp"]


def test_filter_active_moves_no_row_for_few_ids(spark, monkeypatch):
    data = [(u, m, 4.0, 1) for u in range(1, 9) for m in range(10, 14)]
    data += [(9, 10, 1.0, 1), (1, 99, 1.0, 2), (None, 10, 2.0, 3), (None, 11, 2.0, 3), (2, None, 2.0, 3), (3, None, 2.0, 3), (None, None, 1.0, 1)] * 2
    df = spark.createDataFrame(data, SCHEMA)
    out = R.filter_active(df, min_user=3, min_item=3)
    got = rows(out)
    assert got == sorted(d for d in data if d[0] not in (None, 9) and d[1] not in (None, 99))
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "FEW_IDS", 0)
    assert rows(R.filter_active(df, min_user=3, min_item=3)) == got
