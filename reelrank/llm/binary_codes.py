"""Near-duplicate embeddings by randomised-rotation binary codes.

Two vectors of one label link when their cosine is ``threshold`` or more.  Every unit vector is
turned by a random rotation and stored as the signs of its components with a correction factor,
its inner product with its own code.  A code's inner product with another (turned) vector over
that factor estimates the cosine without bias, and the error is within
``CONFIDENCE * sqrt((1 - f^2) / f^2 / (dim - 1))`` but for a chance far below that of the index
(both codes of a pair are asked).  Pairs whose upper bound reaches the threshold are recomputed
in doubles; only these can link.

Index: further rotations give bucket keys of ``bits`` signs each.  ``bits`` grows with the
logarithm of a label's rows, so buckets keep their size, and the number of tables follows from
it such that a pair at the threshold shares a bucket with a chance of ``1 - MISS``.  A pair is
counted in the first table in which it shares a bucket.

Hot groups: the mean direction of a bucket above ``TILE`` rows is a ball's centre, and rows
within half the threshold's angle of a centre belong to the ball: any two of them link by the
triangle inequality, so a group of near copies is counted by its size, its rows are compared
with rows outside only, and no pairs arise within it.  Other large buckets are cut into tiles of
``TILE`` rows, and every two tiles are compared.  A task returns a row's number of links and one
row to reach, never pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null label, link with nothing and stand for themselves.  Vectors of different lengths do not
link.  Repeated ids are rows of their own; a component's id is its smallest non-null one (a row
with a null id alone: null) and rows with that id are kept.  Below ``SHORT`` components all pairs
of a bucket are recomputed.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelrank.llm import vectors
from reelrank.llm.graph import components
from reelrank.llm.store import Scratch

THRESHOLD = 0.93
BUCKET = 512  # rows of a label that share a key by chance
MISS = 0.005
CONFIDENCE = 4.0
TILE = 2_048
SHORT = 16
SEED = 12
SLACK = 1e-6
STEP = 256  # rows of a tile that are compared with the other tile at a time

CODED = "rid long, label long, dim int, vec binary, code binary, factor float, keys array<int>"


# ---------------------------------------------------------------- codes and keys

@cache
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1 (zero rows stay zero)."""
    largest = np.abs(matrix).max(axis=1, keepdims=True)
    matrix = matrix / np.where(largest > 0, largest, 1)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length > 0, length, 1)


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs after rotation 0, and the correction factors."""
    turned = units @ rotation(units.shape[1], 0).T
    return np.packbits(turned > 0, axis=1), (np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])).astype(np.float32)


def estimates(code: np.ndarray, factor: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every coded vector with every unit vector: the cosine's estimate; and the error's bound for each coded vector."""
    dim = units.shape[1]
    signs = (2.0 * np.unpackbits(code, axis=1, count=dim) - 1).astype(np.float32) / np.float32(np.sqrt(dim))
    turned = (units @ rotation(dim, 0).T).astype(np.float32)
    f = factor.astype(np.float64)
    return (signs @ turned.T) / factor[:, None], CONFIDENCE * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1)) + SLACK


def bits_of(rows: int) -> int:
    """Signs in a key: buckets of about BUCKET rows, two bits at least once there is more than one bucket."""
    return min(31, max(0, int(np.ceil(np.log2(max(rows, 1) / BUCKET)))))


def tables_of(bits: int, threshold: float) -> int:
    """Tables in which a pair at the threshold shares one key of ``bits`` signs with a chance of 1 - MISS."""
    if bits == 0:
        return 1
    same = (1 - np.arccos(threshold) / np.pi) ** bits
    return int(np.ceil(np.log(MISS) / np.log1p(-same)))


def keys_of(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): the signs after each table's rotations as a number."""
    dim = units.shape[1]
    per_table = -(-bits // dim)
    out = np.zeros((len(units), tables), np.int32)
    for t in range(tables):
        planes = np.concatenate([rotation(dim, 1 + t * per_table + j) for j in range(per_table)])[:bits] if bits else np.zeros((0, dim))
        out[:, t] = ((units @ planes.T) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else 0
    return out


def _matrix(column, dtype) -> np.ndarray:
    return vectors.unpacked(column, dtype).astype(np.float64)


def _read(dtype):
    """Rows with their vector's bytes; unusable vectors and labels have a length of 0."""
    schema = pa.schema([("rid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])

    def run(batches):
        for batch in batches:
            dim, vec = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            labelled = ~batch["label"].is_null().to_numpy(zero_copy_only=False)
            for at, matrix in vectors.by_length(batch["vector"]):
                fine = (matrix != 0).any(axis=1) & labelled[at]
                dim[at[fine]] = matrix.shape[1]
                for i, b in zip(at[fine], vectors.packed(matrix[fine].astype(dtype)), strict=True):
                    vec[i] = b
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["vec_id"], batch["label"], pa.array(dim), pa.array(vec, pa.binary())], schema=schema)
    return run


def _code(dtype, threshold):
    schema = pa.schema([("rid", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("code", pa.binary()),
                        ("factor", pa.float32()), ("keys", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            shape = np.stack([batch["dim"].to_numpy(), [bits_of(n) for n in batch["n"].to_numpy()]], axis=1)
            for dim, bits in np.unique(shape, axis=0):
                rows = batch.take(pa.array(np.flatnonzero((shape == (dim, bits)).all(axis=1))))
                units = unit(_matrix(rows["vec"], dtype))
                code, factor = encode(units)
                keys = keys_of(units, int(bits), tables_of(int(bits), threshold))
                yield pa.RecordBatch.from_arrays(
                    [rows["rid"], rows["label"], rows["dim"], rows["vec"], pa.array(vectors.packed(code), pa.binary()), pa.array(factor),
                     pa.array(list(keys), pa.list_(pa.int32()))], schema=schema)
    return run


# ---------------------------------------------------------------- balls

def _sums(dtype, near: float | None):
    """Partial sums of unit vectors by centre (with ``near``: of those within that angle of it)."""
    def run(batches):
        for batch in batches:
            for centre in np.unique(batch["centre"].to_numpy()):
                rows = batch.take(pa.array(np.flatnonzero(batch["centre"].to_numpy() == centre)))
                units = unit(_matrix(rows["vec"], dtype))
                if near is not None:
                    mean = np.frombuffer(rows["mean"][0].as_py(), np.float64)
                    units = units[units @ mean >= np.cos(near)]
                if len(units):
                    yield pa.RecordBatch.from_pydict({"centre": [centre], "n": [len(units)], "total": [units.sum(axis=0).tobytes()]},
                                                     schema=pa.schema([("centre", pa.int64()), ("n", pa.int64()), ("total", pa.binary())]))
    return run


def _mean(table: pa.Table) -> pa.Table:
    total = unit(_matrix(table["total"], np.float64).sum(axis=0)[None])
    return pa.table({"centre": table["centre"][:1], "rows": pa.array([sum(table["n"].to_pylist())], pa.int64()), "mean": pa.array([total.tobytes()])})


def _centre_keys(threshold):
    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("centre", pa.int64()), ("rows", pa.int64()), ("mean", pa.binary()),
                        ("table", pa.int32()), ("key", pa.int32())])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                bits = bits_of(r["n"])
                keys = keys_of(np.frombuffer(r["mean"], np.float64)[None], bits, tables_of(bits, threshold))[0]
                yield pa.RecordBatch.from_pydict({
                    **{c: [r[c]] * len(keys) for c in ("label", "dim", "centre", "rows", "mean")}, "table": list(range(len(keys))),
                    "key": keys}, schema=schema)
    return run


def _within(dtype, angle: float):
    """rid, centre, rows of the centre: rows within ``angle`` of a centre that they share a key with."""
    def run(batches):
        for batch in batches:
            for dim in np.unique(batch["dim"].to_numpy()):
                rows = batch.take(pa.array(np.flatnonzero(batch["dim"].to_numpy() == dim)))
                cosine = (unit(_matrix(rows["vec"], dtype)) * _matrix(rows["mean"], np.float64)).sum(axis=1)
                yield rows.take(pa.array(np.flatnonzero(cosine >= np.cos(angle)))).select(["rid", "centre", "rows"])
    return run


def _balls(coded: DataFrame, counts: DataFrame, scratch: Scratch, dtype, threshold: float, tile: int) -> DataFrame | None:
    """rid, ball: rows of which any two link because they lie within half the threshold's angle of one centre; None without large buckets."""
    half = (np.arccos(threshold) - SLACK) / 2
    key = ["label", "dim", "key"]
    first = coded.select("rid", "label", "dim", "vec", F.col("keys")[0].alias("key"))
    large = scratch.save(first.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > tile).select(
        *key, F.monotonically_increasing_id().alias("centre")))
    if not large.limit(1).count():
        return None
    inside = first.join(large, key).select("centre", "vec")
    summed, mean = "centre long, n long, total binary", "centre long, rows long, mean binary"
    means = scratch.save(inside.mapInArrow(_sums(dtype, None), summed).groupBy("centre").applyInArrow(_mean, mean))
    # once more over the rows near the mean, without those that share the key by chance
    means = scratch.save(inside.join(means, "centre").select("centre", "vec", "mean").mapInArrow(_sums(dtype, 2 * half), summed).groupBy(
        "centre").applyInArrow(_mean, mean))
    centres = scratch.save(large.join(means, "centre").join(counts, ["label", "dim"]).select(
        "label", "dim", "n", "centre", "rows", "mean").mapInArrow(_centre_keys(threshold),
                                                                  "label long, dim int, centre long, rows long, mean binary, table int, key int"))
    met = coded.select("rid", "label", "dim", "vec", F.posexplode("keys").alias("table", "key")).join(centres, ["label", "dim", "table", "key"])
    close = met.select("rid", "dim", "centre", "rows", "vec", "mean").mapInArrow(_within(dtype, half), "rid long, centre long, rows long")
    return scratch.save(close.groupBy("rid").agg(F.max_by("centre", F.struct("rows", "centre")).alias("ball")))


# ---------------------------------------------------------------- comparison

def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] in ``labels`` (each row's smallest known member)."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _compare(dtype, threshold: float):
    """Links of a bucket's rows, or between two of its tiles: rid, n, root."""
    def run(rows: pa.Table) -> pa.Table:
        # the first tile's rows first; within one tile every pair once
        rows = rows.sort_by([("side", "ascending"), ("rid", "ascending")])
        side, table = rows["side"].to_numpy(), rows["table"][0].as_py()
        n, n_left = len(side), int((side == 0).sum())
        one = rows["p"][0].as_py() == rows["q"][0].as_py()
        units = unit(_matrix(rows["vec"], dtype))
        code, factor = vectors.unpacked(rows["code"], np.uint8), rows["factor"].to_numpy()
        ball = rows["ball"].fill_null(-1).to_numpy()
        earlier = np.array(rows["before"].to_pylist(), np.int32).reshape(n, table)
        links, labels = np.zeros(n, np.int64), np.arange(n)
        right = np.arange(n) if one else np.arange(n_left, n)
        for at in range(0, n if one else n_left, STEP):
            left = np.arange(at, min(at + STEP, n if one else n_left))
            likely = left[:, None] < right[None, :]
            if units.shape[1] >= SHORT and len(right):
                by_left, e_left = estimates(code[left], factor[left], units[right])
                by_right, e_right = estimates(code[right], factor[right], units[left])
                likely &= (by_left + e_left[:, None] >= threshold) & (by_right.T + e_right[None, :] >= threshold)
            some = np.flatnonzero(likely.any(axis=0))
            exact = units[left] @ units[right[some]].T
            i, j = np.nonzero(likely[:, some] & (exact >= threshold))
            a, b = left[i], right[some[j]]
            new = (ball[a] != ball[b]) | (ball[a] < 0)
            for t in range(table):
                new &= earlier[a, t] != earlier[b, t]
            a, b = a[new], b[new]
            links += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            _hook(labels, a, b)
        found = np.flatnonzero(links)
        rid = rows["rid"].to_numpy()
        return pa.table({"rid": pa.array(rid[found], pa.int64()), "n": pa.array(links[found]), "root": pa.array(rid[labels[found]], pa.int64())})
    return run


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", label_col: str = "label",
                    vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = Scratch(rows.sparkSession, "binary-codes")
    element = rows.schema[vector_col].dataType.elementType
    dtype = np.float32 if isinstance(element, T.FloatType) else np.float64
    base = scratch.save(rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"),
                                    F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")).mapInArrow(
        _read(dtype), "rid long, vec_id long, label long, dim int, vec binary"))
    usable = base.filter("dim > 0").drop("vec_id")
    counts = scratch.save(usable.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    coded = scratch.save(usable.join(counts, ["label", "dim"]).select("rid", "label", "dim", "n", "vec").mapInArrow(_code(dtype, threshold), CODED))
    balls = _balls(coded, counts, scratch, dtype, threshold, tile)

    coded = coded.withColumn("ball", F.lit(None).cast("long")) if balls is None else coded.join(balls, "rid", "left")
    bucket = ["label", "dim", "table", "key"]
    dealt = coded.select("*", F.posexplode("keys").alias("table", "key"))
    sizes = dealt.groupBy(*bucket, "ball").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy(*bucket).orderBy(F.col("ball").asc_nulls_first())
    # buckets of one tile without a ball need no entry
    large = scratch.save(sizes.withColumn("tiles", F.ceil(F.col("n") / tile)).select(
        *bucket, F.coalesce("ball", F.lit(-1)).alias("b"), "tiles",
        (F.sum("tiles").over(in_order) - F.col("tiles")).alias("first"), F.sum("tiles").over(Window.partitionBy(*bucket)).alias("all")).filter(
        (F.col("all") > 1) | (F.col("b") >= 0)))
    own = dealt.withColumn("b", F.coalesce("ball", F.lit(-1))).join(large, [*bucket, "b"], "left").withColumn(
        "mine", F.coalesce(F.col("first") + F.pmod(F.xxhash64("rid"), F.col("tiles")), F.lit(0)))
    others = F.filter(F.sequence(F.lit(0), F.coalesce(F.col("all"), F.lit(1)) - 1),
                      lambda q: (F.col("b") < 0) | (q < F.col("first")) | (q >= F.col("first") + F.col("tiles")))
    pairs = own.withColumn("other", F.explode(others)).select(
        "label", "dim", "table", "key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "rid", "vec", "code", "factor",
        "ball", F.slice("keys", F.lit(1), F.col("table")).alias("before"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    found = scratch.save(pairs.groupBy("label", "dim", "table", "key", "p", "q").applyInArrow(_compare(dtype, threshold), "rid long, n long, root long"))

    links = found.select("rid", "n")
    edges = found.filter("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b"))
    if balls is not None:
        size = balls.groupBy("ball").agg((F.count(F.lit(1)) - 1).alias("n"), F.min("rid").alias("root"))
        members = balls.join(size, "ball").filter("n > 0")
        links = links.unionByName(members.select("rid", "n"))
        edges = edges.unionByName(members.filter("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    linked = scratch.save(links.groupBy("rid").agg(F.sum("n").alias("n_links")).join(
        components(edges, scratch).select(F.col("node").alias("rid"), "component"), "rid"))
    named = scratch.save(base.select("rid", "vec_id").join(linked, "rid", "left"))
    # saved, so that rows of a large component are split over tasks of the join
    least = scratch.save(named.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("component_id")))
    alone = named.filter("component is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.join(least, "component").select("vec_id", "n_links", "component_id").unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
