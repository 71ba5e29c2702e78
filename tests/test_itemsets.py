import pytest

from reelrank.operators import itemsets, rules


def test_two_passes_find_what_fp_growth_finds(spark):
    # item "hot" is in every basket
    data = [(k, ["hot"] + [f"i{j}" for j in range(12) if (k * (j + 3)) % 7 < 3] + (["i1"] if k % 5 else [])) for k in range(400)]
    df = spark.createDataFrame([*data, (400, None), (401, [])], "userId long, items array<string>").repartition(6)
    for support in (0.1, 0.3, 0.5):
        ours = itemsets.frequent_itemsets_by_parts(df, support, part_rows=60, block_sets=40)
        model = rules.mine_rules(df.na.fill({}).filter("items is not null"), support)
        want = {tuple(sorted(set(r["items"]))): r["freq"] for r in rules.frequent_itemsets(model).collect()}
        n = df.count()
        got = {tuple(r["items"]): r["freq"] for r in ours.collect()}
        # FP-Growth was fitted without the null basket: only the least count can differ
        assert {k: v for k, v in want.items() if v >= support * n} == {k: v for k, v in got.items()}


def test_a_hot_item_is_spread_over_the_parts(spark):
    df = spark.range(0, 3000).selectExpr("array('hot', concat('x', id % 40)) as items")
    out = itemsets.frequent_itemsets_by_parts(df, 0.02, part_rows=100)
    assert out.filter("size(items) = 1 and items[0] = 'hot'").first()["freq"] == 3000
    assert out.count() == 81


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "items array<string>")
    assert itemsets.frequent_itemsets_by_parts(empty, 0.5).count() == 0
    one = spark.createDataFrame([(["a", "a", None, "b"],)], "items array<string>")
    assert sorted(r["items"] for r in itemsets.frequent_itemsets_by_parts(one, 1.0).collect()) == [["a"], ["a", "b"], ["b"]]
    with pytest.raises(ValueError):
        itemsets.frequent_itemsets_by_parts(one, 0.0)


def _fp_growth(df, support, confidence):
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(df.selectExpr("array_distinct(items) as items"))
    sets = {tuple(sorted(r["items"], key=str)): r["freq"] for r in model.freqItemsets.collect()}
    rows = {(tuple(sorted(r["antecedent"], key=str)), tuple(r["consequent"])): (r["confidence"], r["lift"], r["support"])
            for r in model.associationRules.collect()}
    return sets, rows


def test_mined_rules_equal_fp_growths_to_the_last_bit(spark):
    data = [(k, [f"i{j}" for j in range(9) if (k * (j + 3)) % 7 < 4] + ([None] if k % 2 else []) + (["i1"] if k % 5 else [])) for k in range(300)]
    words = spark.createDataFrame([*data, (300, None), (301, [])], "userId long, items array<string>").repartition(5)
    numbers = words.selectExpr("userId", "transform(items, x -> cast(substr(x, 2) as int)) as items")
    for df in (words, numbers):
        for support, confidence, parts in ((0.1, 0.1, 4), (0.4, 0.6, None)):
            model = rules.mine_rules(df, support, confidence, num_partitions=parts)
            got = {tuple(sorted(r["items"], key=str)): r["freq"] for r in rules.frequent_itemsets(model).collect()}
            found = {(tuple(sorted(r["antecedent"], key=str)), tuple(r["consequent"])): (r["confidence"], r["lift"], r["support"])
                     for r in rules.association_rules(model).collect()}
            assert (got, found) == _fp_growth(df, support, confidence)
            assert len(got) > 10 and len(found) > 5


def test_mining_is_dealt_by_baskets_and_not_by_items(spark, monkeypatch):
    # FP-Growth grows a tree of all baskets for each of the three items, whatever their number
    sizes = spark.sparkContext.accumulator(0)
    here = itemsets.frequent_here

    def counted(part, least):
        assert len(part) < 400
        sizes.add(1)
        return here(part, least)

    monkeypatch.setattr(itemsets, "frequent_here", counted)
    df = spark.range(1000).selectExpr("filter(array('a', 'b', 'c'), x -> x <> 'c' or id % 3 = 0) as items")  # no null element
    model = rules.mine_rules(df, 0.2, num_partitions=5)
    assert {tuple(r["items"]): r["freq"] for r in model.freqItemsets.collect()}[("a", "b")] == 1000
    assert sizes.value >= 5


def test_only_asked_items_get_a_bit_a_basket():
    """Titles that no candidate names cost no memory: a part of 50,000 baskets holds hundreds of thousands of them."""
    import pyarrow as pa

    from reelrank.operators.itemsets import _occurrences

    baskets = pa.chunked_array([pa.array([["a", f"only {k}", None] for k in range(100)], pa.list_(pa.string()))])
    assert set(_occurrences(baskets, among={"a", None, "nowhere"})) == {"a", None}
    assert len(_occurrences(baskets)) == 102 and _occurrences(baskets, among=set()) == {}
    assert _occurrences(baskets, among={"a"})["a"] == _occurrences(baskets)["a"] == (1 << 100) - 1
