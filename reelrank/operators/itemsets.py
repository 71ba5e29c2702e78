"""Frequent itemsets in two passes over parts of the baskets.

Spark ML's FP-Growth grows one conditional tree per group of items, so an item
in a third of all baskets makes one task with a third of the rows.  Here the
baskets are dealt into parts of bounded size.  An itemset that reaches the
support over all baskets reaches it in at least one part, so

1. every part lists the itemsets that are frequent within it (candidates);
2. every part counts all candidates exactly, and the sums decide.

An item's rows are spread over all parts, however frequent it is.  Candidates
travel to the parts in blocks, so a task holds one part and one block; baskets
of null or no items count towards the number of baskets, as in FP-Growth.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.session import cut_lineage

PART_ROWS = 50_000
BLOCK_SETS = 100_000


def _order(item):
    return item is None, item


def _occurrences(baskets: pa.ChunkedArray, least: int = 1, among: set | None = None) -> dict[str, int]:
    """Per item of ``least`` baskets or more (of those ``among``) the baskets that hold it, as the bits of a number:
    up to a bit a basket and item, so only for items that are asked for."""
    sets = baskets.combine_chunks()
    if not len(sets):
        return {}
    coded = pc.dictionary_encode(pc.list_flatten(sets), null_encoding="encode")
    codes, owners = coded.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(sets).to_numpy()
    by_item = owners[np.argsort(codes, kind="stable")]
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    found = {}
    for item, end, n in zip(coded.dictionary.to_pylist(), np.cumsum(counts), counts):
        if n >= least and (among is None or item in among):
            held = np.zeros(len(sets), np.uint8)
            held[by_item[end - n:end]] = 1
            found[item] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
    return found


def frequent_here(baskets: pa.ChunkedArray, least: int) -> list[list[str]]:
    """All itemsets (sorted items) in ``least`` baskets or more, by growing sets item by item."""
    found: list[list[str]] = []
    items = sorted(_occurrences(baskets, least).items(), key=lambda i: _order(i[0]))
    todo = [([], items)]
    while todo:
        prefix, rest = todo.pop()
        for k, (item, rows) in enumerate(rest):
            found.append([*prefix, item])
            longer = [(other, both) for other, theirs in rest[k + 1:] if (both := rows & theirs).bit_count() >= least]
            if longer:
                todo.append((found[-1], longer))
    return found


def frequent_itemsets_by_parts(baskets: DataFrame, min_support: float, items_col: str = "items",
                               part_rows: int = PART_ROWS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """items (sorted array<string>), freq long: what FP-Growth finds, without a task per item.  Null items are left out."""
    if not 0 < min_support <= 1:
        raise ValueError("min_support must be in (0, 1]")
    sets = F.array_distinct(F.filter(F.coalesce(items_col, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return frequent_sets(baskets.select(sets.alias("items")), min_support, part_rows, block_sets)[0]


def frequent_sets(baskets: DataFrame, min_support: float, part_rows: int = PART_ROWS,
                  block_sets: int = BLOCK_SETS, parts: int | None = None) -> tuple[DataFrame, int]:
    """items (sorted), freq long of ``baskets`` (items, distinct in a basket, no null basket), and the number
    of baskets.  A null item is an item like any other.  ``parts`` sets the number of parts."""
    rows = cut_lineage(baskets.select("items", F.monotonically_increasing_id().alias("_row")))
    n, kind = rows.count(), rows.schema["items"].dataType.simpleString()
    parts = parts or max(1, -(-n // part_rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int")).select("part", "items")

    def local(part: pa.Table) -> pa.Table:
        least = max(1, math.ceil(min_support * part.num_rows - 1e-9))
        return pa.table({"items": pa.array(frequent_here(part["items"], least), pa.list_(part.schema.field("items").type.value_type))})

    # Written once: the same candidates are sent to every part
    candidates = cut_lineage(dealt.groupBy("part").applyInArrow(local, f"items {kind}").distinct())
    blocks = max(1, -(-candidates.count() // block_sets))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = candidates.withColumn("block", F.pmod(F.xxhash64("items"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    told = dealt.withColumn("block", every(blocks))

    def count(sets: pa.Table, part: pa.Table) -> pa.Table:
        listed, keep, freq = sets["items"].to_pylist() if sets.num_rows else [], [], []
        where = _occurrences(part["items"], among={item for items in listed for item in items}) if listed and part.num_rows else {}
        for items in listed:
            rows = -1
            for item in items:
                rows &= where.get(item, 0)
            if rows:
                keep.append(items)
                freq.append(rows.bit_count())
        return pa.table({"items": pa.array(keep, pa.list_(sets.schema.field("items").type.value_type)), "freq": pa.array(freq, pa.int64())})

    counted = asked.groupBy("part", "block").cogroup(told.groupBy("part", "block")).applyInArrow(count, f"items {kind}, freq long")
    return counted.groupBy("items").agg(F.sum("freq").alias("freq")).filter(F.col("freq") >= math.ceil(min_support * n)), n
