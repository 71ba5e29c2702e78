"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every row gets the SHA-256 of its text without ASCII white space, and from
   it a fingerprint of ``BITS`` bits; a narrow table of these is written.
2. The table is dealt into parts by ``doc_id``.  A part sorts its distinct
   fingerprints and sends each owner (a slice of the fingerprint range) one
   message: the gaps between them, Golomb-Rice coded, and a bitmap of those it
   holds more than once.
3. An owner decodes its messages and answers each with a bitmap of the
   fingerprints that occur anywhere else as well.
4. Rows whose bit is set are suspects.  Only their texts are shuffled: they are
   grouped by the normalised text itself (byte comparison), with partial
   aggregation, so a text held by a third of all rows leaves each task once.

Parts and owners grow with the number of rows (``PART_ROWS`` a part), so that
no part or owner has to hold more than its slice.  Defined cases: null counts
as empty; all texts without a visible character are one group; of rows equal in
all columns any one is the kept row, and each of them names the same keep_id;
a null doc_id is kept only where its group has no other id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.llm.store import ASCII_SPACE, Scratch, text_or_empty

BITS = 48
PART_ROWS = 500_000


# ---------------------------------------------------------------- Golomb-Rice coding

def rice_parameter(n: int, span: int) -> int:
    """Bits kept verbatim of each gap: log2 of ln 2 times the mean gap."""
    return max(0, int(np.log2(max(1.0, 0.69 * span / max(1, n)))))


def golomb_encode(values: np.ndarray, low: int, k: int) -> bytes:
    """Sorted distinct integers >= low: the gaps' quotients in unary, then their k low bits each."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(low))
    quot = gaps >> k
    ends = np.cumsum(quot + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    head = np.array([len(values), len(unary)], np.int64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(data: bytes, low: int, k: int) -> np.ndarray:
    n, n_unary = np.frombuffer(data, np.int64, 2)
    split = 16 + (int(n_unary) + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data[16:split], np.uint8), count=int(n_unary)))
    quot = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(data[split:], np.uint8), count=int(n) * k).reshape(int(n), k)
    rest = (bits.astype(np.int64) << np.arange(k)).sum(axis=1) if k else np.zeros(int(n), np.int64)
    return np.cumsum((quot.astype(np.int64) << k) + rest) + low


# ---------------------------------------------------------------- the exchange

def _send(owners: int, bits: int):
    width = -(-(1 << bits) // owners)

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        fp, count = np.unique(rows["fp"].to_numpy(np.int64), return_counts=True)
        cuts = np.searchsorted(fp, np.arange(owners + 1, dtype=np.int64) * width)
        out = []
        for o in range(owners):
            a, b = cuts[o], cuts[o + 1]
            if b > a:
                k = rice_parameter(b - a, width)
                out.append((o, part, k, golomb_encode(fp[a:b], o * width, k),
                            np.packbits(count[a:b] > 1).tobytes()))
        return pd.DataFrame(out, columns=["owner", "part", "k", "gaps", "twice"])
    return send


def _answer(owners: int, bits: int):
    width = -(-(1 << bits) // owners)

    def answer(msgs: pd.DataFrame) -> pd.DataFrame:
        owner = int(msgs["owner"].iloc[0])
        got = [golomb_decode(g, owner * width, int(k)) for g, k in zip(msgs["gaps"], msgs["k"])]
        fp, count = np.unique(np.concatenate(got), return_counts=True)
        bitmaps = []
        for own, twice in zip(got, msgs["twice"]):
            here = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(own)).astype(bool)
            bitmaps.append(np.packbits(here | (count[np.searchsorted(fp, own)] > 1)).tobytes())
        return pd.DataFrame({"part": msgs["part"].to_numpy(), "owner": owner, "hits": bitmaps})
    return answer


def _mark(owners: int, bits: int):
    width = -(-(1 << bits) // owners)

    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """The part's fingerprints whose bit is set."""
        if not len(rows):
            return pd.DataFrame({"fp": np.empty(0, np.int64)})
        fp = np.unique(rows["fp"].to_numpy(np.int64))
        hit = np.zeros(len(fp), bool)
        cuts = np.searchsorted(fp, np.arange(owners + 1, dtype=np.int64) * width)
        for owner, bitmap in zip(answers["owner"], answers["hits"]):
            a, b = cuts[owner], cuts[owner + 1]
            hit[a:b] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
        return pd.DataFrame({"part": int(rows["part"].iloc[0]), "fp": fp[hit]})
    return mark


def suspect_fingerprints(rows: DataFrame, n_parts: int, bits: int = BITS) -> DataFrame:
    """(part, fp) of ``rows`` (part, fp) whose fingerprint occurs more than once in the whole table."""
    owners = n_parts
    msgs = rows.groupBy("part").applyInPandas(
        _send(owners, bits), "owner int, part int, k int, gaps binary, twice binary")
    answers = msgs.groupBy("owner").applyInPandas(_answer(owners, bits), "part int, owner int, hits binary")
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(
        _mark(owners, bits), "part int, fp long")


def exact_groups(docs: DataFrame, bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """Every row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm = F.translate(text_or_empty(), ASCII_SPACE, "")

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("norm", norm).withColumn("sha", F.sha2("norm", 256)).withColumn(
            "fp", F.conv(F.substring("sha", 1, bits // 4), 16, 10).cast("long"))

    src = docs.select("doc_id", "text")
    base = scratch.save(keyed(src).select("doc_id", F.unhex("sha").alias("sha"), "fp", F.length(text_or_empty()).alias("chars")))
    n_parts = max(8, -(-base.count() // part_rows))
    deal = F.pmod(F.xxhash64("doc_id", "fp"), F.lit(n_parts)).cast("int").alias("part")
    hits = scratch.save(suspect_fingerprints(base.select(deal, "fp"), n_parts, bits).select("fp").distinct())

    # Suspects' texts, grouped by their bytes.  Longest original first, then smallest id.
    best = F.max_by("doc_id", F.struct("chars", -F.coalesce(F.col("doc_id"), F.lit(2 ** 62))))
    suspects = keyed(src).withColumn("chars", F.length(text_or_empty())).join(hits, "fp", "left_semi")
    classes = suspects.groupBy("fp", "norm").agg(best.alias("keep_id"), F.count("*").alias("group_size")).filter(
        "group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    classes = scratch.save(classes)
    out = base.join(classes, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
