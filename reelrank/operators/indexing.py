"""Contiguous integer ids for users or films (0 = most frequent), with the
mapping table to go back: what Spark ML's ``StringIndexer`` computes, in the
same order (frequency desc, ties by the id's string form), but without
gathering all labels on the driver: ``StringIndexer.fit`` collects the whole
label list, which does not fit there for hundreds of millions of users.

Plan: one aggregate (partial, so hot keys cost nothing), one range-
partitioned global sort, then each row's position inside its sorted
partition (the low 33 bits of ``monotonically_increasing_id``) plus the
number of rows in all earlier partitions.  The per-partition counts table
has one row per partition, so broadcasting it is bounded by the partition
count, not by the data.  The sorted table is checkpointed to the shared
checkpoint folder first (persisted instead when none is configured), so both
passes see the same partitions even if executors are lost in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelrank.session import cut_lineage

_ROW_BITS = 33


def contiguous_index(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """col, out_col (long, 0-based, contiguous): one row per distinct value."""
    out_col = out_col or f"{col}Index"
    counts = (df.filter(F.col(col).isNotNull())
              .groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_label", F.col(col).cast("string")))
    ordered = (counts.orderBy(F.col("_n").desc(), F.col("_label").asc())
               .withColumn("_mid", F.monotonically_increasing_id())
               .select(col, (F.shiftright("_mid", _ROW_BITS)).alias("_part"),
                       (F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)).alias("_pos")))
    ordered = cut_lineage(ordered)
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition: a bounded, unpartitioned running sum
    offsets = sizes.select(
        "_part",
        (F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_offset"))
    return (ordered.join(F.broadcast(offsets), "_part")
            .select(col, (F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_pos")).alias(out_col)))


def apply_index(df: DataFrame, mapping: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Replace-by-join: add ``out_col`` to ``df`` from a mapping table."""
    out_col = out_col or f"{col}Index"
    return df.join(mapping.select(col, out_col), col)


def extend_index(mapping: DataFrame, df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """``mapping`` with a number for every id of ``df`` that has none: old ids keep
    theirs, new ones follow in the order of ``contiguous_index``.  Read from a
    written mapping, the result is the next version of it."""
    out_col = out_col or f"{col}Index"
    new = contiguous_index(df.join(mapping.select(col), col, "left_anti"), col, out_col)
    start = mapping.agg(F.coalesce(F.max(out_col) + 1, F.lit(0).cast("long"))).scalar()
    return mapping.select(col, out_col).unionByName(new.select(col, (F.col(out_col) + start).alias(out_col)))


def invert_index(df: DataFrame, mapping: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """The way back: replace ``out_col`` in ``df`` by the id it stands for."""
    out_col = out_col or f"{col}Index"
    rest = [c for c in df.columns if c != out_col]
    return df.join(mapping.select(col, out_col), out_col).select(col, *rest)
