"""Hard negatives of anchor vectors by angular triangle filtering.

Vectors become integers (``floor(scale * x)``, x as double) and a score is their integer
inner product.  For every anchor: its ``n_positives`` best rows of the same label, and for
each of them the ``n_negatives`` best rows of other labels whose score lies from ``low`` to
``high`` percent of the positive's.

Stored with every vector: its norm and its angles to ``REFERENCES`` fixed directions.  For an
anchor at angle s and a row at angle t to one direction, the angle between the two lies from
``|s - t|`` to ``min(s + t, 2 pi - s - t)``; the largest of the one and the smallest of the other
over all directions give a cosine interval, and the norms a score interval, widened by ``SLACK``
against rounding (angles are float32).  Only rows whose interval reaches an anchor's best
scores so far (positives), or overlaps its windows (negatives), are scored in integers.

Scale: all rows against all anchors is the task; rows and anchors are dealt into tiles by a hash
of a row number, so neither a hot label nor repeated rows make a large one, and a task gets one
tile of each.  A tile returns at most ``n_positives`` (and ``n_negatives`` a positive) rows an
anchor; the rest is a top-k per anchor.  No anchor table is broadcast or sent to the driver.

Edge cases: rows with a null label, a null or empty vector, or a null or non-finite component
(also after scaling) take no part.  Ties go to the smaller id, null ids last, then to row order;
rows that repeat an id are rows of their own.  Vectors of different lengths are not compared.
Scores beyond 53 bits are computed in whole numbers and end at the limits of a long.  A label
without other rows has no positives, and an empty table no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelrank.llm import vectors
from reelrank.llm.store import Scratch

REFERENCES = 16
SLACK = 1e-5
SEED = 13
ROW_TILE, SMALL_TILE, ANCHOR_TILE = 16_384, 1_024, 8_192
CHUNK = 64  # anchors that are bounded together
LONG = 2 ** 63 - 1

STORED = "rid long, id long, label long, dim int, ints binary, norm double, angles binary, anchor boolean"


def directions(dim: int) -> np.ndarray:
    """Fixed orthonormal reference directions of a space."""
    q, _ = np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(dim, min(dim, REFERENCES))))
    return q


def angles(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the reference directions (a zero vector: a right angle)."""
    largest = np.abs(ints).max(axis=1, keepdims=True)
    part = ints / np.where(largest > 0, largest, 1)
    length = np.sqrt((part * part).sum(axis=1, keepdims=True))
    cosine = (part / np.where(length > 0, length, 1)) @ directions(ints.shape[1])
    return (largest * length)[:, 0], np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def _stored(scale: float):
    schema = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("ints", pa.binary()),
                        ("norm", pa.float64()), ("angles", pa.binary()), ("anchor", pa.bool_())])

    def run(batches):
        for batch in batches:
            for at, matrix in vectors.by_length(batch["vector"]):
                with np.errstate(over="ignore"):
                    ints = np.floor(scale * matrix)
                fine = np.isfinite(ints).all(axis=1)
                at, ints = at[fine], ints[fine]
                if not len(at):
                    continue
                small = np.abs(ints).max() < 2 ** 31
                norm, angle = angles(ints)
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [rows["rid"], rows["id"], rows["label"], pa.array(np.full(len(at), ints.shape[1], np.int32)),
                     pa.array(vectors.packed(ints.astype(np.int32) if small else ints), pa.binary()), pa.array(norm),
                     pa.array(vectors.packed(angle), pa.binary()), rows["anchor"]], schema=schema)
    return run


class Tile:
    """Rows of one task, by id (null last), then by row number."""

    def __init__(self, table: pa.Table):
        ids = table["id"].to_numpy().astype(np.float64) if table["id"].null_count else table["id"].to_numpy()
        order = np.lexsort((table["rid"].to_numpy(), ids, table["id"].is_null().to_numpy()))
        table = table.take(pa.array(order))
        self.ids, self.rid = table["id"].to_pylist(), table["rid"].to_numpy()
        self.label, self.norm = table["label"].to_numpy(), table["norm"].to_numpy()
        self.angles = vectors.unpacked(table["angles"], np.float32)
        dim, rows = table["dim"][0].as_py(), table["ints"].to_pylist()
        self.ints = np.stack([np.frombuffer(r, np.int32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in rows])
        self.windows = table["scores"].to_pylist() if "scores" in table.column_names else None
        self.positives = table["positives"].to_pylist() if "positives" in table.column_names else None


def bounds(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of every pair, from angles and norms."""
    near = np.zeros((len(a), len(b)), np.float32)
    far = np.full((len(a), len(b)), np.pi, np.float32)
    for s, t in zip(a.T, b.T, strict=True):
        np.maximum(near, np.abs(s[:, None] - t), out=near)
        both = s[:, None] + t
        np.minimum(far, np.minimum(both, np.float32(2 * np.pi) - both), out=far)
    norms = norm_a[:, None] * norm_b
    return norms * (np.cos(np.minimum(far + SLACK, np.pi)) - SLACK) - 1, norms * (np.cos(np.maximum(near - SLACK, 0)) + SLACK) + 1


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles hold them exactly below 2^53."""
    if a.size == 0 or b.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2 ** 53:
        return a @ b.T
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.array([[max(-LONG - 1, min(LONG, x)) for x in row] for row in whole], object)


def wanted_scores(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Columns with any wanted pair, the scores there (wanted pairs at least), and how many were computed."""
    some = np.flatnonzero(wanted.any(axis=0))
    wanted, b = wanted[:, some], b[some]
    if wanted.size == 0 or wanted.mean() > 0.25 or np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2 ** 53:
        return some, scores(a, b), wanted.size
    out = np.zeros(wanted.shape)
    i, j = np.nonzero(wanted)
    for at in range(0, len(i), 2 ** 16):
        p, q = i[at:at + 2 ** 16], j[at:at + 2 ** 16]
        out[p, q] = np.einsum("ij,ij->i", a[p], b[q])
    return some, out, len(i)


def best_positives(anchors: Tile, rows: Tile, k: int) -> tuple[dict[str, list], int]:
    """Up to ``k`` best rows of every anchor's label in the tile, and the number of pairs scored."""
    out: dict[str, list] = {"anchor": [], "rid": [], "id": [], "score": []}
    scored = 0
    for label in np.unique(anchors.label):
        mine, theirs = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        for at in range(0, len(mine) if len(theirs) else 0, CHUNK):
            chunk = mine[at:at + CHUNK]
            _, upper = bounds(anchors.angles[chunk], rows.angles[theirs], anchors.norm[chunk], rows.norm[theirs])
            self_row = anchors.rid[chunk][:, None] == rows.rid[theirs]
            upper[self_row] = -np.inf
            wanted = np.ones(upper.shape, bool)
            if len(theirs) > 4 * k:
                # the k-th best score among rows that look best along the directions is a floor for the rest
                guess = (np.cos(anchors.angles[chunk]) * anchors.norm[chunk][:, None]) @ (np.cos(rows.angles[theirs]) * rows.norm[theirs][:, None]).T
                guess[self_row] = -np.inf
                likely = np.unique(np.argpartition(-guess, k, axis=1)[:, :k + 1])
                first = scores(anchors.ints[chunk], rows.ints[theirs[likely]])
                first = np.where(self_row[:, likely], -LONG - 1, first)
                floor = np.partition(first, len(likely) - k, axis=1)[:, len(likely) - k] if first.dtype != object else np.sort(first, axis=1)[:, -k]
                wanted = upper >= floor[:, None].astype(np.float64)
            wanted &= ~self_row
            some, exact, n = wanted_scores(anchors.ints[chunk], rows.ints[theirs], wanted)
            wanted, scored = wanted[:, some], scored + n
            for i, a in enumerate(chunk):
                cols = np.flatnonzero(wanted[i])
                cols = cols[np.argsort(-exact[i, cols], kind="stable")[:k]]
                for c in cols:
                    j = theirs[some[c]]
                    out["anchor"].append(anchors.rid[a])
                    out["rid"].append(rows.rid[j])
                    out["id"].append(rows.ids[j])
                    out["score"].append(int(exact[i, c]))
    return out, scored


def best_negatives(anchors: Tile, rows: Tile, k: int, low: int, high: int) -> tuple[dict[str, list], int]:
    """Up to ``k`` best rows of other labels in the window of every anchor's positives, and the number of pairs scored."""
    out: dict[str, list] = {"anchor": [], "positive": [], "rid": [], "id": [], "score": []}
    scored = 0
    # whole scores s with low * p <= 100 * s <= high * p
    windows = [[(-(-low * p // 100), high * p // 100) for p in ps] for ps in anchors.windows]
    for at in range(0, len(anchors.rid), CHUNK):
        chunk = np.array([i for i in range(at, min(at + CHUNK, len(anchors.rid))) if any(a <= b for a, b in windows[i])], int)
        if not len(chunk):
            continue
        least = np.array([min(a for a, b in windows[i] if a <= b) for i in chunk], np.float64)
        most = np.array([max(b for a, b in windows[i] if a <= b) for i in chunk], np.float64)
        lower, upper = bounds(anchors.angles[chunk], rows.angles, anchors.norm[chunk], rows.norm)
        wanted = (upper >= least[:, None]) & (lower <= most[:, None]) & (anchors.label[chunk][:, None] != rows.label)
        some, exact, n = wanted_scores(anchors.ints[chunk], rows.ints, wanted)
        wanted, scored = wanted[:, some], scored + n
        for i, a in enumerate(chunk):
            fits = np.zeros(len(some), bool)
            for lo, hi in windows[a]:
                fits |= (exact[i] >= lo) & (exact[i] <= hi)
            cols = np.flatnonzero(fits & wanted[i])
            cols = cols[np.argsort(-exact[i, cols], kind="stable")]
            found = exact[i, cols]
            for (lo, hi), positive in zip(windows[a], anchors.positives[a], strict=True):
                for c in cols[(found >= lo) & (found <= hi)][:k]:
                    j = some[c]
                    out["anchor"].append(anchors.rid[a])
                    out["positive"].append(positive)
                    out["rid"].append(rows.rid[j])
                    out["id"].append(rows.ids[j])
                    out["score"].append(int(exact[i, c]))
    return out, scored


def _table(columns: dict[str, list]) -> pa.Table:
    return pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()})


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   row_tile: int = ROW_TILE, anchor_tile: int = ANCHOR_TILE) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    taken = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"),
                        F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"),
                        F.coalesce(is_anchor, F.lit(False)).alias("anchor")).filter("label is not null and vector is not null")
    stored = scratch.save(taken.mapInArrow(_stored(scale), STORED))
    n, n_anchors = stored.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    anchor_tiles = max(1, -(-n_anchors // anchor_tile))
    # enough row tiles to keep the cluster busy, none above row_tile rows
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions")) // anchor_tiles
    row_tiles = max(1, -(-n // row_tile), min(parallel, -(-n // SMALL_TILE)))
    place = lambda tiles: F.pmod(F.xxhash64("rid"), F.lit(tiles)).cast("int")
    every = lambda tiles: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    tile = ["dim", "row_tile", "anchor_tile"]
    dealt = stored.drop("anchor").withColumn("row_tile", place(row_tiles)).withColumn("anchor_tile", every(anchor_tiles)).groupBy(tile)
    again = spark.read.schema(stored.schema).parquet(stored._scratch_path)  # cogroup needs columns of its own on either side
    anchors = again.filter("anchor").drop("anchor").withColumn("anchor_tile", place(anchor_tiles))

    def positives(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _table({c: [] for c in ("anchor", "rid", "id", "score")})
        return _table(best_positives(Tile(b), Tile(a), n_positives)[0])

    def negatives(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _table({c: [] for c in ("anchor", "positive", "rid", "id", "score")})
        return _table(best_negatives(Tile(b), Tile(a), n_negatives, low, high)[0])

    best = (F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("rid"))
    first = lambda df, keys, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(
        F.col("rank") <= k)
    found = dealt.cogroup(anchors.withColumn("row_tile", every(row_tiles)).groupBy(tile)).applyInArrow(
        positives, "anchor long, rid long, id long, score long")
    chosen = scratch.save(first(found, ["anchor"], n_positives).select("anchor", F.col("rid").alias("positive"), F.col("id").alias("positive_id"),
                                                                       F.col("score").alias("positive_score")))
    per_anchor = chosen.groupBy(F.col("anchor").alias("rid")).agg(  # at most n_positives entries
        F.array_sort(F.collect_list(F.struct("positive", "positive_score"))).alias("p")).select(
        "rid", F.col("p.positive").alias("positives"), F.col("p.positive_score").alias("scores"))
    wanted = anchors.join(per_anchor, "rid").withColumn("row_tile", every(row_tiles))
    found = dealt.cogroup(wanted.groupBy(tile)).applyInArrow(negatives, "anchor long, positive long, rid long, id long, score long")
    ranked = first(found, ["anchor", "positive"], n_negatives)
    ids = stored.filter("anchor").select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    return ranked.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        chosen, ["anchor", "positive"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
