from reelrank.operators.indexing import apply_index, contiguous_index, extend_index, invert_index


def test_matches_string_indexer_order(spark):
    from pyspark.ml.feature import StringIndexer

    data = [(u,) for u in [5, 5, 5, 10, 10, 2, 2, 7, 100, 3, 3, 3]]
    df = spark.createDataFrame(data, "userId long").repartition(3)
    ours = {r.userId: r.userIndex for r in contiguous_index(df, "userId", "userIndex").collect()}
    si = StringIndexer(inputCol="u", outputCol="i").fit(df.selectExpr("cast(userId as string) u"))
    theirs = {int(lbl): i for i, lbl in enumerate(si.labels)}
    assert ours == theirs
    assert sorted(ours.values()) == list(range(len(ours)))


def test_many_partitions_contiguous(spark):
    df = spark.range(0, 5000).selectExpr("id % 1234 as userId").repartition(16)
    idx = contiguous_index(df, "userId")
    vals = sorted(r.userIdIndex for r in idx.collect())
    assert vals == list(range(1234))
    assert apply_index(df, idx, "userId").count() == 5000


def test_extended_index_keeps_old_numbers(spark):
    old = spark.createDataFrame([(k % 7 + 2 ** 40,) for k in range(50)], "userId long")
    new = spark.createDataFrame([(k % 11 + 2 ** 40,) for k in range(60)], "userId long")
    first = contiguous_index(old, "userId")
    second = extend_index(first, new, "userId")
    a, b = dict(map(tuple, first.collect())), dict(map(tuple, second.collect()))
    assert {k: b[k] for k in a} == a and sorted(b.values()) == list(range(11))
    assert extend_index(second, old, "userId").exceptAll(second).count() == 0
    assert sorted(map(tuple, extend_index(first.limit(0), old, "userId").collect())) == sorted(a.items())
    there = apply_index(new, second, "userId").drop("userId")
    assert sorted(r.userId for r in invert_index(there, second, "userId").collect()) == sorted(r.userId for r in new.collect())
