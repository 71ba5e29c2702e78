"""Mixing sources to target weights by capped water-filling (native DataFrame code).

``water_fill`` gives each source its weight's share of the budget, clamps
those above ``max_epochs`` times their size, and shares the rest again by
weight until none is above.  ``mixture`` then takes every document of a source
floor(target / size) times, and once more those whose seeded hash lies before
the place where the remaining words are reached.  That place is found by
grouped sums over hash slices (``HEX`` digits a round), so a source with a
third of all rows is never sorted or gathered in one task.

Defined cases: null text has no words; null is a source like any other, last
in code-point order; a source without words has target 0 and its documents are
never taken; an empty table gives an empty plan; rows repeating a doc_id are
taken or left together.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelrank.llm.store import Scratch, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
MAX_EPOCHS = 3
HEX = 3                       # hex digits of the hash that one round resolves
BROADCAST_SOURCES = 100_000   # a plan of up to so many sources is broadcast, a larger one joined by shuffle


def cycle_weights(sources: DataFrame, cycle=(1, 2, 3)) -> DataFrame:
    """sources (one row each) with ``weight``: ``cycle`` repeated in code-point order, null last."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]),
                                                     ((nth - 1) % len(cycle) + 1).cast("int")).cast("long"))


def water_fill(sources: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) with ``target`` (double), summing to ``budget`` where the caps allow.

    Each round is one grouped sum over the sources; only its two numbers reach the driver.
    """
    cap = F.col("source_size").cast("decimal(38,0)") * max_epochs
    rest, weight = Decimal(int(budget)), Decimal(int(sources.agg(F.sum("weight")).first()[0] or 0))
    clamped = -1
    while weight > 0:
        # above the cap at the present level: rest * weight / weights > cap
        above = F.col("weight").cast("decimal(38,0)") * F.lit(rest) > cap * F.lit(weight)
        got = sources.filter(above).agg(F.count("*").alias("n"), F.sum(cap).alias("cap"), F.sum("weight").alias("w")).first()
        if got["n"] == clamped:
            break
        clamped = got["n"]
        total_w = int(sources.agg(F.sum("weight")).first()[0])
        rest, weight = Decimal(int(budget) - int(got["cap"] or 0)), Decimal(total_w - int(got["w"] or 0))
    if weight <= 0:
        return sources.withColumn("target", cap.cast("double"))
    above = F.col("weight").cast("decimal(38,0)") * F.lit(rest) > cap * F.lit(weight)
    share = F.lit(float(rest)) * F.col("weight").cast("double") / F.lit(float(weight))
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(share))


def _seeded():
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with ``cut``: documents of the source with hash <= cut are taken once more."""
    # one row a source: rows join it in place and only sums of slices are shuffled
    few = F.broadcast if plan.count() <= BROADCAST_SOURCES else lambda df: df
    goals = plan.select("sid", "goal").withColumn("base", F.lit(0).cast("long")).withColumn("prefix", F.lit(""))
    for _ in range(2):
        inside = rows.join(few(goals), "sid").filter(F.col("goal") > 0).filter(F.expr("u like prefix || '%'"))
        sums = inside.groupBy("sid", "goal", "base", "prefix", F.expr(f"substr(u, 1, length(prefix) + {HEX})").alias("next")) \
            .agg(F.sum("size").alias("w"))
        upto = F.col("base") + F.sum("w").over(Window.partitionBy("sid").orderBy("next"))
        sums = sums.withColumn("upto", upto).filter(F.col("upto") >= F.col("goal"))
        goals = sums.groupBy("sid").agg(F.min(F.struct("next", "goal", F.expr("upto - w").alias("base"))).alias("c")).select(
            "sid", F.col("c.goal").alias("goal"), F.col("c.base").alias("base"), F.col("c.next").alias("prefix"))
    inside = rows.join(few(goals), "sid").filter(F.expr("u like prefix || '%'"))
    last = inside.groupBy("sid", "goal", "base", "prefix", "u").agg(F.sum("size").alias("w"))
    last = last.withColumn("upto", F.col("base") + F.sum("w").over(Window.partitionBy("sid").orderBy("u")))
    best = last.groupBy("sid").agg(
        F.min(F.struct(F.abs(F.expr("upto - goal")).alias("off"), "u")).alias("b"),
        F.first("prefix").alias("prefix"), F.first(F.abs(F.expr("base - goal"))).alias("off_none"))
    cut = best.select("sid", F.when(F.col("off_none") <= F.col("b.off"), F.col("prefix")).otherwise(F.col("b.u")).alias("cut"))
    return plan.join(cut, "sid", "left").withColumn("cut", F.coalesce("cut", F.lit("")))


def mixture_plan(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights=cycle_weights, share: float = 1.0) -> DataFrame:
    """One row a source: source, source_size, weight, target, whole (full repetitions) and cut
    (documents whose seeded hash is <= cut are taken once more)."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"))
    # later rounds read hashes and sizes, not texts
    rows = scratch.save(sized.withColumn("u", _seeded()).withColumn("sid", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    sources = scratch.save(weights(rows.groupBy("source", "sid").agg(F.sum("size").alias("source_size"))))
    budget = int((sources.agg(F.sum("source_size")).first()[0] or 0) * share) if share != 1.0 else \
        int(sources.agg(F.sum("source_size")).first()[0] or 0)
    plan = water_fill(sources, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    out = scratch.save(_cuts(rows.select("sid", "u", "size"), plan))
    scratch.drop(rows)
    return out


def words(col: str = "text"):
    """Words of the text: maximal runs of anything but ASCII white space."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def with_repeats(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with the plan's columns (prefixed ``mix_``) and ``mix_repeats``: how often the mix takes the document."""
    p = plan.select(F.col("sid").alias("mix_sid"), F.col("source_size").alias("mix_source_size"),
                    F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole"), F.col("cut").alias("mix_cut"))
    if plan.count() <= BROADCAST_SOURCES:
        p = F.broadcast(p)
    sid = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    joined = docs.withColumn("mix_sid", sid).join(p, "mix_sid")
    return joined.withColumn("mix_repeats", F.col("mix_whole") + F.when(_seeded() <= F.col("mix_cut"), 1).otherwise(0))


def mixture(docs: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan takes it, with the columns of ``docs``."""
    taken = with_repeats(docs, plan if plan is not None else mixture_plan(docs)).filter("mix_repeats > 0")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_repeats"))).alias("mix_copy")
    return taken.select(*docs.columns, again).drop("mix_copy")
