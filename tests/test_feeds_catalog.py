import json

from testkit import rows

from pyspark.sql import functions as F

from reelrank.functions.catalog import pick_trailer, project_movie_detail
from reelrank.operators import feeds as FE

LISTS = "userId long, items array<long>"


def _popular(spark):
    return spark.createDataFrame([(1, 100, 1000, 5, 4.0), (2, 200, None, 4, 4.0)],
                                 "rank int, movieId long, tmdbId long, count long, avg_rating double")


def test_user_feed_tiers(spark):
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 6, 9)], "userId long")
    t1 = spark.createDataFrame([(1, [11, 12]), (6, [])], LISTS)
    t2 = spark.createDataFrame([(3, [33]), (6, [66]), (9, [])], LISTS)
    got = {r.userId: (r.source, list(r["items"])) for r in FE.user_feed(users, t1, t2, _popular(spark)).collect()}
    assert got == {
        1: ("precomputed", [11, 12]),
        2: ("popular", [100, 200]),
        3: ("als", [33]),
        6: ("popular", [100, 200]),   # cached empty list: popular, not the ALS list
        9: ("popular", [100, 200]),
    }


def test_fallback_is_scalar_subquery_not_join(spark):
    users = spark.createDataFrame([(1,)], "userId long")
    empty = spark.createDataFrame([], LISTS)
    plan = FE.user_feed(users, empty, empty, _popular(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_resolve_feed_drops_unmapped(spark):
    feed = spark.createDataFrame([(1, "popular", [100, 200, 300])], "userId long, source string, items array<long>")
    links = spark.createDataFrame([(100, "a", 7.0), (300, "c", 9.0)], "movieId long, imdbId string, tmdbId double")
    assert rows(FE.resolve_feed(feed, links, "userId")) == [(1, "popular", 1, 100, 7), (1, "popular", 3, 300, 9)]


def test_movie_feed(spark):
    movies = spark.createDataFrame([(1,), (2,)], "movieId long")
    related = spark.createDataFrame([(1, [5, 6])], "movieId long, items array<long>")
    got = {r.movieId: (r.source, list(r["items"])) for r in FE.movie_feed(movies, related, _popular(spark)).collect()}
    assert got == {1: ("rules", [5, 6]), 2: ("popular", [100, 200])}


def _doc(**kw):
    return json.dumps(kw)


def test_detail_projection_cases(spark):
    videos_trailer_after_clip = _doc(results=[
        {"site": "YouTube", "type": "Clip", "key": "c"}, {"site": "YouTube", "type": "Trailer", "key": "t"}])
    videos_non_youtube = _doc(results=[{"site": "Vimeo", "type": "Trailer", "key": "v"}])
    data = [
        (1, _doc(title="A", poster_path="/p.jpg", backdrop_path="", genres=[{"name": "x"}, {"name": "y"}],
                 images={"logos": [{"file_path": "/l1.png"}, {"file_path": "/l2.png"}]}),
         videos_trailer_after_clip),
        (2, _doc(title="B", poster_path=None, images={"logos": []}), videos_non_youtube),
        (3, _doc(title="C"), None),
        (4, "{}", None),
        (5, None, None),
    ]
    df = spark.createDataFrame(data, "tmdbId long, detail string, videos string")
    out = {r.tmdbId: r for r in project_movie_detail(df, keep=("tmdbId",)).collect()}
    assert set(out) == {1, 2, 3}
    a, b, c = out[1], out[2], out[3]
    assert a.poster.endswith("w500/p.jpg") and a.backdrop is None and list(a.genres) == ["x", "y"]
    assert a.logo.endswith("w300/l1.png") and a.trailer_key == "t"
    assert b.poster is None and b.logo is None and b.trailer_key is None and list(b.genres) == []
    assert c.logo is None and c.trailer_key is None


def test_pick_trailer_falls_back_to_first_youtube(spark):
    df = spark.createDataFrame(
        [([("Vimeo", "Trailer", "v"), ("YouTube", "Featurette", "f"), ("YouTube", "Teaser", "g")],)],
        "v array<struct<site:string,type:string,key:string>>")
    assert df.select(pick_trailer("v")).first()[0] == "f"


def _records(spark, ids):
    from reelrank.functions.catalog import DETAIL_FIELDS

    base = spark.createDataFrame([(i, i * 10) for i in ids], "movieId long, tmdbId long")
    nothing = [F.lit(None).cast("string").alias(c) for c in DETAIL_FIELDS if c != "title"]
    return base.select("movieId", "tmdbId", F.concat(F.lit("film "), "movieId").alias("title"), *nothing,
                       F.col("movieId").alias("id"))


def test_detailed_feed_drops_films_without_record(spark):
    feed = spark.createDataFrame([(1, "als", [100, 7, 8]), (2, "popular", [100, 200]), (3, "popular", [100, 200]), (4, "als", [])],
                                 "userId long, source string, items array<long>")
    got = FE.detailed_feed(feed, _records(spark, [100, 8]), _popular(spark), "userId")
    assert rows(got.select("userId", "source", "position", "tmdbId", "title")) == [
        (1, "als", 1, 1000, "film 100"), (1, "als", 3, 80, "film 8"),
        (2, "popular", 1, 1000, "film 100"), (3, "popular", 1, 1000, "film 100")]
    assert rows(FE.popular_details(_popular(spark), _records(spark, [200, 8])).select("rank", "id")) == [(2, 200)]


def test_movie_page_records(spark):
    movies = spark.createDataFrame([(1,), (2,), (3,)], "movieId long")
    related = spark.createDataFrame([(1, [3, 2])], "movieId long, items array<long>")
    got = FE.movie_page_records(movies, _records(spark, [1, 2, 100]), related, _popular(spark))
    assert rows(got.select("movieId", "source", "position", "id")) == [
        (1, "page", 0, 1), (1, "rules", 2, 2), (2, "page", 0, 2), (2, "popular", 1, 100)]
