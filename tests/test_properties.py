"""Property checks on random inputs: the skew-safe operators give exactly
what the plain (unbalanced) Spark formulation gives."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelrank.operators.ranking import row_number_within

ROWS = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 40), st.integers(0, 3)),
                min_size=1, max_size=120)
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(rows=ROWS, parts=st.integers(1, 6))
def test_row_number_within_equals_window(spark, rows, parts):
    df = spark.createDataFrame([(g, v, w, i) for i, (g, v, w) in enumerate(rows)],
                               "g long, v long, w long, i long").repartition(parts)
    order = [F.col("w").desc(), F.col("v").asc(), F.col("i").asc()]
    ours = row_number_within(df, "g", order, "rk").select("i", "rk").collect()
    plain = df.withColumn("rk", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(map(tuple, ours)) == sorted(map(tuple, plain.select("i", "rk").collect()))



@SETTINGS
@given(rows=ROWS, min_user=st.integers(1, 6), min_item=st.integers(1, 4))
def test_activity_filter_equals_counts(spark, rows, min_user, min_item):
    from collections import Counter

    from reelrank.operators.ratings import filter_active

    df = spark.createDataFrame([(u, m, float(r), i) for i, (u, m, r) in enumerate(rows)],
                               "userId long, movieId long, rating double, timestamp long").repartition(3)
    users, movies = Counter(u for u, _, _ in rows), Counter(m for _, m, _ in rows)
    got = sorted(r.timestamp for r in filter_active(df, min_user, min_item).collect())
    assert got == [i for i, (u, m, _) in enumerate(rows) if users[u] >= min_user and movies[m] >= min_item]
