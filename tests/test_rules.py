import pytest
from testkit import rows

from reelrank.operators import rules as RU

RULE_SCHEMA = "antecedent array<string>, consequent array<string>, confidence double, lift double, support double"


def _baskets(spark):
    data = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c", "d"], ["d"]]
    return spark.createDataFrame([(i, x) for i, x in enumerate(data)], "userId long, items array<string>")


def test_rules_match_definitions(spark):
    model = RU.mine_rules(_baskets(spark), min_support=0.5, min_confidence=0.1)
    fi = {tuple(sorted(r["items"])): r["freq"] for r in RU.frequent_itemsets(model).collect()}
    assert fi == {("a",): 4, ("b",): 4, ("c",): 4, ("a", "b"): 3, ("a", "c"): 3, ("b", "c"): 3}
    ar = {(tuple(r.antecedent), tuple(r.consequent)): r for r in RU.association_rules(model).collect()}
    r = ar[(("a",), ("b",))]
    assert r.confidence == pytest.approx(3 / 4)
    assert r.lift == pytest.approx((3 / 4) / (4 / 6))
    assert r.support == pytest.approx(3 / 6)


def test_higher_support_gives_subset(spark):
    lo = RU.association_rules(RU.mine_rules(_baskets(spark), 0.3, 0.1))
    hi = RU.association_rules(RU.mine_rules(_baskets(spark), 0.5, 0.1))
    key = lambda df: {(tuple(sorted(r.antecedent)), tuple(r.consequent)) for r in df.collect()}
    assert key(hi) <= key(lo) and len(key(lo)) > len(key(hi))


def test_support_is_validated(spark):
    with pytest.raises(ValueError):
        RU.mine_rules(_baskets(spark), 0.0)


def test_recommend_cuts_rules_before_dedup(spark):
    # item a has 3 rules; top_k=2 keeps the two highest-lift rules, which
    # both point to x: only one film comes back (fewer than top_k).
    rs = spark.createDataFrame([
        (["a"], ["x"], 0.5, 3.0, 0.1),
        (["a", "b"], ["x"], 0.5, 2.5, 0.1),
        (["a"], ["y"], 0.5, 2.0, 0.1),
        (["b"], ["z"], 0.5, 9.0, 0.1),
    ], RULE_SCHEMA)
    items = spark.createDataFrame([("a",), ("q",)], "item string")
    got = rows(RU.recommend_from_rules(rs, items, top_k=2))
    assert got == [("a", 1, "x", 3.0, "Association Rule")]


def test_recommend_rounds_half_even_and_orders(spark):
    rs = spark.createDataFrame([
        (["a"], ["x"], 0.5, 1.125, 0.1),
        (["a"], ["y"], 0.5, 1.135, 0.1),
    ], RULE_SCHEMA)
    items = spark.createDataFrame([("a",)], "item string")
    got = rows(RU.recommend_from_rules(rs, items, top_k=5))
    assert got == [("a", 1, "y", 1.14, "Association Rule"), ("a", 2, "x", 1.12, "Association Rule")]


def test_related_index(spark):
    rs = spark.createDataFrame([
        (["A"], ["B"], 0.5, 2.0, 0.1),
        (["A", "C"], ["B"], 0.5, 5.0, 0.1),
        (["A"], ["C"], 0.5, 3.0, 0.1),
        (["A"], ["Z"], 0.5, 9.0, 0.1),   # Z has no id: dropped
    ], RULE_SCHEMA)
    labels = spark.createDataFrame([(1, "A"), (7, "B"), (3, "B"), (4, "C")], "movieId long, item string")
    got = {r.movieId: list(r["items"]) for r in RU.related_index(rs, labels).collect()}
    # B (id 3) scores 5.0 via the best rule, C (id 4) 3.0; C also leads to B
    assert got == {1: [3, 4], 4: [3]}


def test_rules_top_lift(spark):
    rs = spark.createDataFrame([(["a"], ["b"], 0.1, 1.0, 0.1), (["b"], ["a"], 0.2, 4.0, 0.1)], RULE_SCHEMA)
    assert [r.lift for r in RU.rules_top_lift(rs, 1).collect()] == [4.0]


def test_empty_rules_give_typed_empty(spark, tmp_dir):
    from reelrank.sources import sinks

    model = RU.mine_rules(_baskets(spark), 1.0, 0.1)
    ar = RU.association_rules(model)
    assert ar.count() == 0
    sinks.write_table(ar, tmp_dir + "/rules")
    back = spark.read.parquet(tmp_dir + "/rules")
    assert back.count() == 0 and back.columns == ["antecedent", "consequent", "confidence", "lift", "support"]
