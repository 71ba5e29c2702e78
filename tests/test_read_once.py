"""Queries that read the clean ratings several times build them once, and factors travel as they are stored."""

from pyspark.sql import functions as F

from reelrank.operators import scoring
from reelrank.plans import queries


def _tables(spark, path):
    """12 users x 12 films, each pair once, and users and films of few ratings."""
    lines = spark.range(144).selectExpr("id as l_orderkey", "id % 12 as l_partkey", "cast(id * 7 % 50 + 1 as double) as l_quantity")
    few = spark.range(900, 904).selectExpr("id as l_orderkey", "id as l_partkey", "5.0D as l_quantity")
    orders = spark.range(144).selectExpr("id as o_orderkey", "id div 12 as o_custkey", "timestamp_ntz '2001-01-01 00:00:00' as o_orderdate")
    rest = spark.range(900, 904).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp_ntz '2001-01-01 00:00:00' as o_orderdate")
    lines.unionByName(few).write.parquet(path + "/lineitem.parquet")
    orders.unionByName(rest).write.parquet(path + "/orders.parquet")


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey")


def test_index_roundtrip_reads_written_ratings(spark, tmp_dir):
    _tables(spark, tmp_dir)
    out = queries.REGISTRY["index_roundtrip"](spark, tmp_dir)
    assert _scans(out) == 0
    assert sorted((r.userId, r.movieId) for r in out.collect()) == [(u, m) for u in range(12) for m in range(12)]


def test_als_model_roundtrip_reads_written_ratings(spark, tmp_dir):
    _tables(spark, tmp_dir)
    out = queries.REGISTRY["als_model_roundtrip"](spark, tmp_dir)
    assert _scans(out) == 0
    assert sorted((r.userId, r.n, r.same) for r in out.collect()) == [(u, 12, True) for u in range(12)]


def test_als_fit_optimal_builds_clean_ratings_once(spark, tmp_dir, monkeypatch):
    """The fit and its check read one written copy, without the timestamps that neither needs."""
    _tables(spark, tmp_dir)
    built, written, clean, write = [], [], queries._clean, queries.sinks.write_table
    monkeypatch.setattr(queries, "_clean", lambda *a: built.append(a) or clean(*a))
    monkeypatch.setattr(queries.sinks, "write_table", lambda df, path, *a, **b: written.append(df.columns) or write(df, path, *a, **b))
    out = queries.REGISTRY["als_fit_optimal"](spark, tmp_dir)
    assert _scans(out) == 0 and len(built) == 1
    assert written == [["userId", "movieId", "rating"]]
    assert sorted(tuple(r) for r in out.collect()) == [(u, 12, True, True) for u in range(12)]


def test_float_factors_are_sent_as_floats(spark):
    users = spark.range(4).selectExpr("cast(id as int) as id", "array(cast(id + 0.1 as float), 2.5F, cast(null as float)) as features")
    items = spark.range(3).selectExpr("cast(id as int) as id", "array(1.3F, cast(id as float), 0.5F) as features")
    pairs = users.crossJoin(items.select(F.col("id").alias("movieId"))).select(F.col("id").cast("long").alias("userId"), F.col("movieId").cast("long"))
    whole = lambda df: df.withColumn("features", F.filter("features", lambda x: x.isNotNull()))
    doubles = lambda df: df.withColumn("features", F.col("features").cast("array<double>"))
    short = items.withColumn("features", F.slice("features", 1, 2))
    got = scoring.predict_pairs(pairs, whole(users), short)
    assert "array<double>" not in got._jdf.queryExecution().analyzed().toString()
    assert sorted(got.collect()) == sorted(scoring.predict_pairs(pairs, doubles(whole(users)), doubles(short)).collect())
    assert dict(scoring.fit_residuals(pairs.withColumn("rating", F.lit(3.0)), whole(users), short, 2, 0.1).dtypes)["least"] == "double"


def _parts(spark, path):
    spark.range(12).selectExpr("id as p_partkey", "concat('Brand#', id % 3) as p_brand", "'red' as p_name", "'steel' as p_type",
                               "cast(1 as int) as p_size").write.parquet(path + "/part.parquet")


def test_profile_queries_build_ratings_once(spark, tmp_dir, monkeypatch):
    _tables(spark, tmp_dir)
    _parts(spark, tmp_dir)
    built, view = [], queries.tv.ratings
    monkeypatch.setattr(queries.tv, "ratings", lambda *a: built.append(a) or view(*a))
    monkeypatch.setattr(queries, "MIN_VOTES", 12)
    out = queries.REGISTRY["profile_candidates_gated"](spark, tmp_dir)
    assert _scans(out) == 0 and len(built) == 1
    assert out.groupBy("userId").count().filter("count = 5").count() == 12


def test_als_lists_verified_makes_its_lists_once(spark, tmp_dir, monkeypatch):
    _tables(spark, tmp_dir)
    written, write = [], queries.sinks.write_table
    monkeypatch.setattr(queries.sinks, "write_table", lambda df, path, *a, **b: written.append(df.columns) or write(df, path, *a, **b))
    out = queries.REGISTRY["als_lists_verified"](spark, tmp_dir)
    assert ["userId", "pos", "movieId", "rating"] in written
    assert sorted(r.userId for r in out.filter("n = 12 and ordered and scored").collect()) == list(range(12))
