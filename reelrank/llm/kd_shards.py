"""Sharding by a k-d tree over document metadata (native DataFrame code).

The tree cuts the corpus at distributed weighted medians, each node along the
metadata dimension in which its documents are spread widest, until a leaf
holds the target bytes.  A weighted median is found by two grouped sums:
``BINS`` equal slices of the widest dimension, then ``BINS`` slices of a text
hash inside the slice that the median falls into.  Only such sums (at most
``BINS`` rows a node) are windowed; documents never meet in one task.

What is placed is a *unit*: all rows with one text, so that copies share a
shard.  Only a text holding more than 1/``HEAVY`` of a shard's bytes, which the
byte law could not place whole, is spread by ``doc_id`` over units of about
1/``GRAIN`` of a shard.

Defined cases: documents level with a cut are told apart by a hash of their
unit, and those level in that too stay together; a null text counts no byte (plus one), like an empty one, and
both are one text; null metadata has the coordinate 0; an empty table gives an
empty result; repeated rows are placed like any others.  Columns other than
the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelrank.llm.store import Scratch, text_or_empty

BINS = 4096       # slices of a dimension, and of the hash inside one slice
HEAVY = 8         # a text of up to 1/HEAVY of a shard's bytes stays together
GRAIN = 64        # a heavier one is spread over units of about 1/GRAIN of a shard's bytes
SLOT_ROWS = 20_000  # rows numbered together when slots are given
AXES = 4


def _fraction(col):
    """A category's place in [0, 1): its CRC32 over 2^32."""
    return F.coalesce(F.crc32(col.cast("string")) / F.lit(2.0 ** 32), F.lit(0.0))


def _split(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """units with ``node`` moved one level down.  ``nodes`` has (node, leaves):
    a node is named by its first leaf and spans ``leaves`` of them."""
    axes = [f"x{i}" for i in range(AXES)]
    act = units.join(F.broadcast(nodes.filter("leaves > 1")), "node")
    spread = act.groupBy("node").agg(
        *[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes],
        F.sum("bytes").alias("total"))
    widths = F.array(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in axes])
    widest = F.array_position(widths, F.array_max(widths)).cast("int")
    spread = spread.select(
        "node", "total", widest.alias("axis"),
        F.element_at(F.array(*[F.col(f"lo_{a}") for a in axes]), widest).alias("lo"),
        F.array_max(widths).alias("width"))
    place = F.element_at(F.array(*axes), F.col("axis"))
    act = act.join(F.broadcast(spread), "node").withColumn(
        "bin", F.when(F.col("width") > 0, F.least(
            F.lit(BINS - 1), F.floor((place - F.col("lo")) / F.col("width") * BINS)).cast("int")).otherwise(0))
    left = F.floor(F.col("leaves") / 2)
    # one row a node and slice; the slice in which the wanted share is reached
    by_bin = act.groupBy("node", "bin").agg(F.sum("bytes").alias("w"), F.first("total").alias("total"),
                                            F.first("leaves").alias("leaves"))
    run = Window.partitionBy("node").orderBy("bin")
    by_bin = by_bin.withColumn("upto", F.sum("w").over(run)).withColumn(
        "goal", F.col("total") * left / F.col("leaves"))
    cut = by_bin.filter("upto >= goal").groupBy("node").agg(
        F.min(F.struct("bin", F.expr("upto - w").alias("base"), "goal")).alias("c")).select(
        "node", F.col("c.bin").alias("cut_bin"), F.col("c.base").alias("base"), F.col("c.goal").alias("goal"))
    # inside that slice: the place in hash order that comes nearest to the share
    inner = act.join(F.broadcast(cut), "node").filter("bin = cut_bin").groupBy("node", "tie").agg(
        F.sum("bytes").alias("w"), F.first("base").alias("base"), F.first("goal").alias("goal"))
    inner = inner.withColumn("upto", F.col("base") + F.sum("w").over(
        Window.partitionBy("node").orderBy("tie")))
    near = inner.groupBy("node").agg(
        F.min(F.struct(F.abs(F.expr("upto - goal")).alias("off"), "tie")).alias("best"),
        F.first(F.abs(F.expr("base - goal"))).alias("off_none"))
    near = near.select("node", F.when(F.col("off_none") <= F.col("best.off"), F.lit(-1))
                       .otherwise(F.col("best.tie")).alias("cut_tie"))
    cuts = cut.join(near, "node").select("node", "cut_bin", "cut_tie")
    moved = act.join(F.broadcast(cuts), "node").withColumn(
        "node", F.when((F.col("bin") < F.col("cut_bin"))
                       | ((F.col("bin") == F.col("cut_bin")) & (F.col("tie") <= F.col("cut_tie"))),
                       F.col("node")).otherwise(F.col("node") + left).cast("int"))
    done = units.join(F.broadcast(nodes.filter("leaves = 1").select("node")), "node", "left_semi")
    return moved.select(*units.columns).unionByName(done)


def _halves(nodes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The nodes of the next level: (first leaf, leaves).  They follow from the number of shards alone."""
    return [h for node, n in nodes for h in ([(node, n)] if n == 1 else [(node, n // 2), (node + n // 2, n - n // 2)])]


def _node_table(spark, nodes: list[tuple[int, int]]) -> DataFrame:
    """(node, leaves) from one literal, so that the plan is as small at every level."""
    each = spark.range(1).select(F.explode(F.split(F.lit(",".join(f"{a}:{n}" for a, n in nodes)), ",")).alias("p"))
    part = lambda i: F.split("p", ":")[i].cast("int")
    return each.select(part(0).alias("node"), part(1).alias("leaves"))


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    Give ``n_shards``, or ``target_bytes`` of a shard.  ``docs`` needs doc_id and text; source, lang
    and n_chars serve as dimensions where present, besides doc_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd")
    have = set(docs.columns)
    meta = lambda c: F.col(c) if c in have else F.lit(None)
    text = text_or_empty()
    rows = scratch.save(docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("grp"),
        _fraction(meta("source")).alias("x0"), _fraction(meta("lang")).alias("x1"),
        F.log2(F.octet_length(text) + 2.0).alias("x2"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("x3")))
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"),
                     *[f(c).alias(f"{n}_{c}") for c in ("x2", "x3") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = whole["bytes"] or 0
    shards = n_shards or max(1, -(-total // target_bytes))
    grain = max(1, total // (shards * GRAIN))

    # Fewer than shards * HEAVY texts can be that heavy: a bounded table.
    heavy = rows.groupBy("grp").agg(F.sum("size").alias("b")).filter(F.col("b") * shards * HEAVY > total).select(
        "grp", F.ceil(F.col("b") / grain).alias("parts"))
    rows = rows.join(F.broadcast(heavy), "grp", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("long")).drop("parts")

    def scaled(c):
        lo, hi = whole[f"lo_{c}"] or 0.0, whole[f"hi_{c}"] or 0.0
        return (F.min(c) - lo) / ((hi - lo) or 1.0)

    units = scratch.save(rows.groupBy("grp", "salt").agg(
        F.sum("size").alias("bytes"), F.min("x0").alias("x0"), F.min("x1").alias("x1"),
        scaled("x2").alias("x2"), scaled("x3").alias("x3")).withColumn(
        "tie", F.pmod(F.xxhash64(F.lit(17), "grp", "salt"), F.lit(BINS)).cast("int")).withColumn("node", F.lit(0)))
    nodes = [(0, int(shards))]
    while len(nodes) < shards:
        before, units = units, scratch.save(_split(units, _node_table(spark, nodes)))
        scratch.drop(before)
        nodes = _halves(nodes)

    placed = rows.select("doc_id", "size", "text_crc32", "grp", "salt").join(
        units.select("grp", "salt", F.col("node").alias("shard")), ["grp", "salt"])
    # Slots: rows are numbered inside buckets of a shard, from where the bucket before ended.
    buckets = max(8, -(-whole["n"] // (shards * SLOT_ROWS)))
    placed = scratch.save(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "grp"), F.lit(buckets))))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    start = counts.withColumn("start", F.sum("n").over(
        Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "salt"))
    return placed.withColumn("nth", nth).join(start, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"))
