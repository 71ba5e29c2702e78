"""Association rules: FP-Growth mining, rule lookups, related-film index.

Mining finds what Spark ML's FP-Growth finds, by two passes over parts of the
baskets (``operators/itemsets.py``): FP-Growth sends a basket to almost every
group of items and keeps their trees in memory, so with few, frequent items its
trees grow with the number of users.  The cost rises steeply as support falls, so
``min_support`` is validated and defaults to the modelled app's 0.15.

Lookups never scan rules per item: antecedents are exploded once and joined
to the requested items (an equi-join), each item keeps its ``top_k`` rules
through a window with a ``<= top_k`` filter (``WindowGroupLimit``, applied
before the shuffle, so an item that appears in a third of all rules still
ships at most ``top_k`` rows per task), and the surviving lists are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelrank.functions.lists import ordered_list, sorted_key
from reelrank.operators.itemsets import frequent_sets
from reelrank.session import cut_lineage

# Defaults of the modelled app.
MIN_SUPPORT = 0.15
MIN_CONFIDENCE = 0.1
RULE_TYPE = "Association Rule"


@dataclass(frozen=True)
class MinedRules:
    """``freqItemsets`` (items, freq) and ``associationRules`` (antecedent, consequent, confidence, lift, support)."""

    freqItemsets: DataFrame
    associationRules: DataFrame


def mine_rules(baskets: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE, items_col: str = "items",
               num_partitions: int | None = None) -> MinedRules:
    """Frequent itemsets and rules of per-user baskets, with the rows and
    doubles of Spark ML's ``FPGrowthModel``: null baskets don't count.
    ``num_partitions``: parts of the baskets (default: by their number)."""
    if not 0 < min_support <= 1:
        raise ValueError("min_support must be in (0, 1]")
    if not 0 <= min_confidence <= 1:
        raise ValueError("min_confidence must be in [0, 1]")
    tx = baskets.filter(F.col(items_col).isNotNull()).select(F.array_distinct(items_col).alias("items"))
    found, n = frequent_sets(tx, min_support, parts=num_partitions)
    # read three times by the rules
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    found.count()
    return MinedRules(found, _rules_of(found, n, min_confidence))


def _rules_of(itemsets: DataFrame, n: int, min_confidence: float) -> DataFrame:
    """Every frequent itemset without one of its items => that item."""
    whole = itemsets.filter(F.size("items") > 1).select("items", "freq", F.posexplode("items").alias("pos", "one"))
    split = whole.select(F.filter("items", lambda x, i: i != F.col("pos")).alias("antecedent"), F.array("one").alias("consequent"), "freq")
    known = lambda key, name: itemsets.select(F.col("items").alias(key), F.col("freq").alias(name))
    rows = (split.join(known("antecedent", "_antecedent"), "antecedent")
            .join(known("consequent", "_consequent").filter(F.size("consequent") == 1), "consequent"))
    confidence = F.col("freq") / F.col("_antecedent")
    return (rows.select("antecedent", "consequent", confidence.alias("confidence"),
                        (confidence / (F.col("_consequent") / F.lit(n))).alias("lift"), (F.col("freq") / F.lit(n)).alias("support"))
            .filter(F.col("confidence") >= min_confidence))


def frequent_itemsets(model) -> DataFrame:
    """items array<string>, freq long."""
    return model.freqItemsets


def association_rules(model) -> DataFrame:
    """antecedent, consequent (always one item), confidence, lift, support."""
    return model.associationRules.select("antecedent", "consequent", "confidence", "lift", "support")


def _rule_order():
    # lift desc, then confidence desc, then the rule's item sets, so ties
    # are broken the same way on every run.
    return (F.col("lift").desc(), F.col("confidence").desc(),
            sorted_key("antecedent").asc(), sorted_key("consequent").asc())


def rules_top_lift(rules: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rules with the highest lift (a global top-k)."""
    return rules.orderBy(*_rule_order()).limit(k)


def recommend_from_rules(rules: DataFrame, items: DataFrame, top_k: int = 10,
                         item_col: str = "item") -> DataFrame:
    """For each requested item: the consequents of its ``top_k`` highest-lift
    rules (antecedent contains the item), itself excluded, first occurrence
    kept, at most ``top_k``.  Rules are cut *before* de-duplication, so an
    item can get fewer than ``top_k`` films.

    Columns: item, rank, movie, score (lift rounded half-even to 2 places),
    type.
    """
    cand = rules.select(
        F.explode(F.array_distinct("antecedent")).alias("item"),
        "antecedent", "consequent", "confidence", "lift")
    wanted = items.select(F.col(item_col).alias("item"))
    per_item = Window.partitionBy("item").orderBy(*_rule_order())
    # Cut before the join: a task sends at most top_k rules of an item on.
    top = (cand.withColumn("rule_rank", F.row_number().over(per_item))
           .filter(F.col("rule_rank") <= top_k)
           .join(wanted, "item", "left_semi"))
    recs = (top.select("item", "rule_rank", "lift",
                       F.posexplode("consequent").alias("pos", "movie"))
            .filter(F.col("movie") != F.col("item")))
    first = recs.groupBy("item", "movie").agg(
        F.min(F.struct("rule_rank", "pos", "lift")).alias("first"))
    order = Window.partitionBy("item").orderBy(
        F.col("first.rule_rank"), F.col("first.pos"))
    return (first.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= top_k)
            .select("item", "rank", "movie",
                    F.bround(F.col("first.lift"), 2).alias("score"),
                    F.lit(RULE_TYPE).alias("type")))


def label_ids(labels: DataFrame, label_col: str = "item") -> DataFrame:
    """item -> movieId: a label shared by several films maps to the smallest id."""
    return labels.groupBy(F.col(label_col).alias("item")).agg(F.min("movieId").alias("movieId"))


def related_index(rules: DataFrame, labels: DataFrame, top_k: int = 10,
                  label_col: str = "item") -> DataFrame:
    """movieId, items: for every film named in an antecedent, the ids of films
    named in consequents of rules containing it, scored by their best lift,
    ordered by score desc then id, at most ``top_k``.

    ``labels`` maps rule items back to ids (columns movieId and ``label_col``,
    e.g. cleaned titles); labels with no id are dropped.
    """
    pairs = (rules.select(F.explode(F.array_distinct("antecedent")).alias("a"), "consequent", "lift")
             .select("a", F.explode(F.array_distinct("consequent")).alias("c"), "lift")
             .filter(F.col("a") != F.col("c")))
    scored = pairs.groupBy("a", "c").agg(F.max("lift").alias("score"))
    # written once and read by both joins: two plain shuffles each, which AQE can split at a hot label
    ids = cut_lineage(label_ids(labels, label_col))
    a_ids = ids.select(F.col("item").alias("a"), F.col("movieId").alias("a_id"))
    c_ids = ids.select(F.col("item").alias("c"), F.col("movieId").alias("c_id"))
    mapped = scored.join(a_ids, "a").join(c_ids, "c")
    w = Window.partitionBy("a_id").orderBy(F.col("score").desc(), F.col("c_id").asc())
    top = mapped.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    return (top.groupBy(F.col("a_id").alias("movieId"))
            .agg(ordered_list("c_id", "rank").alias("items")))
