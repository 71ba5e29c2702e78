from testkit import SF001

from reelrank.plans import jobs
from reelrank.sources import files, sinks
from reelrank.sources import testviews as tv


def test_pipeline_end_to_end(spark, tmp_dir):
    raw = tmp_dir + "/raw"
    sinks.write_csv(tv.ratings(spark, SF001), raw + "/ratings")
    sinks.write_csv(tv.movies(spark, SF001), raw + "/movies")
    sinks.write_csv(tv.links(spark, SF001), raw + "/links")
    lay = jobs.Layout(tmp_dir + "/out")

    first = jobs.preprocess(spark, raw + "/ratings", raw + "/movies", lay, cap=10)
    assert first == {"skipped": False, "clean_rows": 5382}
    assert jobs.preprocess(spark, raw + "/ratings", raw + "/movies", lay)["skipped"]
    tx = files.read_table(spark, lay.baskets)
    assert tx.columns == ["userId", "items"] and tx.count() > 0

    r = jobs.train_rules(spark, raw + "/movies", lay, min_support=0.01)
    assert not r["skipped"]
    assert files.read_table(spark, lay.rules).count() == r["rules"]
    assert files.read_table(spark, lay.related).columns == ["movieId", "items"]

    assert jobs.train_als(spark, lay, rank=4, max_iter=2) == {"skipped": False}
    assert jobs.train_als(spark, lay) == {"skipped": True}
    recs = files.read_table(spark, lay.als_recs)
    assert dict(recs.dtypes) == {"userId": "bigint", "recommendations": "array<bigint>"}
    clean = files.read_table(spark, lay.als_input)
    assert recs.count() == clean.select("userId").distinct().count()
    shown = recs.selectExpr("explode(recommendations) as movieId").distinct()
    assert shown.join(clean, "movieId", "left_anti").count() == 0
    index = {r.userId: r.userIdIndex for r in files.read_table(spark, lay.user_index).collect()}
    assert jobs.train_als(spark, lay, force=True, rank=4, max_iter=2) == {"skipped": False}
    assert {r.userId: r.userIdIndex for r in files.read_table(spark, lay.user_index).collect()} == index

    pop = jobs.build_popular(spark, raw + "/ratings", raw + "/links", lay)
    assert pop.count() == 20

    users = spark.range(1, 11).withColumnRenamed("id", "userId")
    assert jobs.precompute_user_lists(spark, users, raw + "/ratings", raw + "/movies", lay,
                                      min_votes=5) == {"skipped": False}
    cache = files.read_user_lists_json(spark, lay.user_cache)
    assert cache.count() <= 10
