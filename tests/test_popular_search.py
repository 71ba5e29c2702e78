from testkit import rows

from reelrank.operators import popular as P
from reelrank.operators.search import search_titles

SCHEMA = "userId long, movieId long, rating double, timestamp long"


def _links(spark, data):
    return spark.createDataFrame(data, "movieId long, imdbId string, tmdbId double")


def test_popular_order_and_ties(spark):
    data = ([(u, 1, 4.0, 0) for u in range(3)] + [(u, 2, 5.0, 0) for u in range(3)]
            + [(u, 3, 5.0, 0) for u in range(3)] + [(u, 4, 5.0, 0) for u in range(2)]
            + [(9, 4, None, 0)])
    r = spark.createDataFrame(data, SCHEMA)
    links = _links(spark, [(1, "1", 11.0), (2, "2", None), (3, "3", 33.9)])
    got = rows(P.popular_movies(r, links, top_n=3, min_count=2))
    # counts skip the null rating: film 4 has 2 and ranks last
    assert got == [(1, 2, None, 3, 5.0), (2, 3, 33, 3, 5.0), (3, 1, 11, 3, 4.0)]


def test_popular_prefix_is_prefix(spark):
    r = spark.createDataFrame([(u, m, 3.0, 0) for m in range(8) for u in range(m + 1)], SCHEMA)
    pop = P.popular_movies(r, None, top_n=8, min_count=1)
    a = rows(P.popular_prefix(pop, 3), "movieId")
    b = rows(P.popular_prefix(pop, 4), "movieId")
    assert set(a) < set(b) and len(b) == 4


def test_popular_plan_is_top_n(spark):
    r = spark.createDataFrame([(1, 1, 3.0, 0)], SCHEMA)
    plan = P.popular_movies(r, None)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_external_id_map_drops_and_truncates(spark):
    links = _links(spark, [(1, "1", 7.9), (2, "2", None)])
    assert rows(P.external_id_map(links)) == [(1, 7)]


def _movies(spark):
    return spark.createDataFrame(
        [(1, "Red Widget", "g"), (2, None, "g"), (3, "blue WIDGET (x)", "g"), (4, "other", "g")],
        "movieId long, title string, genres string")


def test_search_case_insensitive_and_null_safe(spark):
    links = _links(spark, [(1, "1", 5.0)])
    got = rows(search_titles(_movies(spark), links, "widget"))
    assert got == [(1, "Red Widget", 5), (3, "blue WIDGET (x)", None)]


def test_search_too_short_is_empty(spark):
    assert search_titles(_movies(spark), None, "w").count() == 0
    assert search_titles(_movies(spark), None, "").count() == 0


def test_search_limit_by_id(spark):
    assert rows(search_titles(_movies(spark), None, "widget", limit=1), "movieId") == [(1,)]


def test_search_regex_and_literal(spark):
    m = _movies(spark)
    assert rows(search_titles(m, None, "^red"), "movieId") == [(1,)]
    assert rows(search_titles(m, None, "(x)", regex=False), "movieId") == [(3,)]


def test_bounded_lookup_narrows_links_by_broadcast(spark):
    # even with automatic broadcasts off, the link table is narrowed to the
    # top-n ids through the bounded broadcast, never shuffled whole
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = spark.createDataFrame([(u, m, 4.0, 0) for m in range(30) for u in range(m % 7 + 1)], SCHEMA)
        links = _links(spark, [(m, str(m), float(m + 100)) for m in range(30)])
        pop = P.popular_movies(r, links, top_n=3, min_count=1)
        assert pop.count() == 3
        plan = pop._jdf.queryExecution().executedPlan().toString()
        assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in plan.split("\n"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_batch_search_equals_single_searches(spark):
    from reelrank.operators import search

    titles = ["The Godfather (1972)", "godFATHER part", "Straße", "STRASSE", "İstanbul", "istanbul ISTANBUL", "Kelvin K", "a.b", "aXb", "Red Dog, The",
              "dogs", "x", "", None, "Οδοσ", "ΟΔΟΣ ΑΒΓ", "father of the god", "Ünlü"]
    movies = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "movieId long, title string").repartition(3)
    links = spark.createDataFrame([(k, float(k)) for k in range(10)], "movieId long, tmdbId double")
    literal = ["godfather", "GOD", "strasse", "ist", "kel", "a.b", "og", "zzz nothing", "x", "", None, "οδοσ", "ünl", "the"]
    patterns = ["^the", "god.*er", "^red.*the$", "a.b", "(dog|kel)", "d[oa]g", "ist", "f.", "g+o", "^$"]
    for regex, terms in ((False, literal), (True, patterns)):
        got = search.search_titles_batch(movies, links, spark.createDataFrame([(t,) for t in terms + terms[:2]], "term string"), 3, regex)
        want = [(t, i + 1, r.movieId, r.title, r.tmdbId) for t in terms if t is not None
                for i, r in enumerate(search.search_titles(movies, links, t, 3, regex).orderBy("movieId").collect())]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_batch_search_broadcasts_nothing(spark, tmp_dir):
    """Tables whose files are small: their trigrams and ids are shuffled all the same."""
    from reelrank.operators import search

    _movies(spark).write.parquet(f"{tmp_dir}/movies")
    _links(spark, [(m, str(m), float(m + 100)) for m in range(5)]).write.parquet(f"{tmp_dir}/links")
    movies, links = spark.read.parquet(f"{tmp_dir}/movies"), spark.read.parquet(f"{tmp_dir}/links")
    for regex in (False, True):
        found = search.search_titles_batch(movies, links, spark.createDataFrame([("widget",), ("re",), ("(d|g)e",)], "term string"), 3, regex)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
        assert ("widget", 1) in rows(found, "term", "movieId")
