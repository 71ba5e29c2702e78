import pytest
from testkit import SF01
from pyspark.sql import functions as F

from reelrank.operators import als, ratings
from reelrank.sources import testviews as tv


@pytest.fixture(scope="module")
def fitted(spark):
    clean = ratings.filter_active(tv.ratings(spark, SF01)).persist()
    model = als.fit_als(clean, max_iter=8)
    return clean, model


def test_top_k_invariants(spark, fitted):
    clean, model = fitted
    recs = als.recommend_all(model, 20).collect()
    items = {r.movieId for r in clean.select("movieId").distinct().collect()}
    assert len(recs) == clean.select("userId").distinct().count()
    for r in recs:
        ids = [x.movieId for x in r.recommendations]
        scores = [x.rating for x in r.recommendations]
        assert len(ids) <= 20 and len(set(ids)) == len(ids)
        assert all(a >= b for a, b in zip(scores, scores[1:]))
        assert all(s >= 0 for s in scores)
        assert set(ids) <= items


def test_fit_beats_global_mean(spark, fitted):
    clean, model = fitted
    pred = model.transform(clean)
    mean = clean.agg(F.avg("rating")).first()[0]
    rmse = pred.select(F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2))).first()[0]
    base = clean.select(F.sqrt(F.avg((F.col("rating") - F.lit(mean)) ** 2))).first()[0]
    assert rmse < base


def test_flatten(spark, fitted):
    _, model = fitted
    flat = als.flatten_recommendations(als.recommend_all(model, 5))
    assert dict(flat.dtypes)["recommendations"] == "array<int>"


def test_gated_lists(spark, fitted):
    clean, model = fitted
    r = tv.ratings(spark, SF01)
    users = spark.createDataFrame([(1,), (2,), (10**9,)], "userId long")  # last one unknown
    out = als.recommend_for_users(model, users, tv.movies(spark, SF01), r, min_votes=30, top_k=5)
    got = out.collect()
    assert {x.userId for x in got} <= {1, 2}
    assert all(x.votes >= 30 for x in got)
    per_user = {}
    for x in got:
        per_user.setdefault(x.userId, []).append(x.rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in per_user.values())
    lists = als.precompute_user_lists(model, users, tv.movies(spark, SF01), r, top_k=3, min_votes=30)
    assert all(len(x["items"]) <= 3 for x in lists.collect())


def test_exclude_seen(spark, fitted):
    clean, model = fitted
    flat = als.recommend_all(model, 10).select("userId", F.explode("recommendations.movieId").alias("movieId"))
    kept = als.exclude_seen(flat.withColumn("movieId", F.col("movieId").cast("long")), clean)
    assert kept.join(clean, ["userId", "movieId"]).count() == 0


def test_cold_start_rows_are_dropped(spark, fitted):
    _, model = fitted
    probe = spark.createDataFrame([(1, 1, 0.0), (10**8, 1, 0.0), (1, 10**8, 0.0)],
                                  "userId long, movieId long, rating double")
    got = model.transform(probe).select("userId", "movieId").collect()
    assert all(r.userId != 10**8 and r.movieId != 10**8 for r in got)


def test_gated_lists_can_exclude_rated(spark, fitted):
    clean, model = fitted
    r = tv.ratings(spark, SF01)
    users = spark.createDataFrame([(u,) for u in range(1, 40)], "userId long")
    kept = als.recommend_for_users(model, users, tv.movies(spark, SF01), r, min_votes=30,
                                   top_k=5, exclude_rated=True)
    assert kept.join(r, ["userId", "movieId"]).count() == 0
    assert kept.count() > 0


def test_blocks_follow_the_ratings(spark, monkeypatch):
    """More ratings than blocks should hold make more blocks, and nothing waits in the heap between the stages."""
    from pyspark.ml.recommendation import ALS

    asked, levels, blocks, level = [], [], ALS.setNumBlocks, ALS.setIntermediateStorageLevel
    monkeypatch.setattr(ALS, "setNumBlocks", lambda self, n: asked.append(n) or blocks(self, n))
    monkeypatch.setattr(ALS, "setIntermediateStorageLevel", lambda self, kind: levels.append(kind) or level(self, kind))
    data = spark.range(60).selectExpr("cast(id % 10 as int) as userId", "cast(id % 6 as int) as movieId", "3.0D as rating")
    assert als.fit_als(data, rank=2, max_iter=1, num_blocks=2, ratings_a_block=10).userFactors.count() == 10
    als.fit_als(data, rank=2, max_iter=1, num_blocks=2)
    assert asked == [6, 2] and levels == ["DISK_ONLY"] * 2
