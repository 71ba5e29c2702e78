"""Hard-negative mining and embedding near-duplicates against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelrank.llm import binary_codes as B
from reelrank.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rid long, score string, id string, dim int"


@pytest.fixture(scope="module")
def vecs(spark):
    def build(rows, parts=3, schema=SCHEMA):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 5, "s", "i", 9)
                                      for i, v, y in rows], schema).repartition(parts)
    return build


def usable(rows):
    return [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows
            if y is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]


def mined_by_force(rows, anchors, n_pos=5, n_neg=3):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in usable(rows)]
    out, last = [], lambda i: (i is None, i or 0)
    for k, (a, v, y) in enumerate(rows):
        if a is None or a not in anchors:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), i, z) for j, (i, w, z) in enumerate(rows) if j != k and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for ps, pi, _ in [s for s in scored if s[2] == y][:n_pos]:
            fits = [s for s in scored if s[2] != y and 50 * ps <= 100 * s[0] <= 95 * ps][:n_neg]
            out += [(a, pi, r + 1, ni, ps, ns) for r, (ns, ni, _) in enumerate(fits)]
    return sorted(out, key=repr)


def mine(df, anchors, **kw):
    got = H.hard_negatives(df, F.col("vec_id").isin(anchors), **kw)
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()),
                  key=repr)


def clustered(n, dim=24, groups=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    return [(k, base[rng.integers(groups)] + 0.4 * rng.normal(size=dim), int(rng.integers(4))) for k in range(n)]


@pytest.mark.parametrize("tiles", [{}, {"row_tile": 40, "anchor_tile": 8}])
def test_hard_negatives_match_brute_force(vecs, tiles):
    rows = clustered(300)
    anchors = list(range(0, 300, 10))
    assert mine(vecs(rows), anchors, **tiles) == mined_by_force(rows, anchors)


def test_hard_negatives_edge_cases(vecs):
    rows = [(0, [1, 0], 1), (0, [1, 0], 1), (1, [1, 0], 1), (2, [0.9, 0.1], 1), (3, [0.6, 0.1], 2), (4, [0.6, 0.1], 2), (None, [0.6, 0.1], 2),
            (5, None, 2), (6, [None, 1], 2), (7, [float("nan"), 1], 2), (8, [float("inf"), 1], 2), (9, [], 2), (10, [0.7, 0], None),
            (11, [0.7, 0, 0], 2), (12, [0, 0], 1), (13, [-1, 0], 1), (14, [0, 0], 2), (15, [0.7, 0.2], 1)]
    assert mine(vecs(rows), [0, 12, 13, 11]) == mined_by_force(rows, [0, 12, 13, 11])
    assert mine(vecs([]), [0]) == []


def test_scores_beyond_53_bits(vecs):
    rows = [(k, [2.0 ** 22 + k, 1, 2.0 ** 21 * (k % 3)], k % 2) for k in range(12)]
    schema = SCHEMA.replace("array<float>", "array<double>")
    exact = [(a, b, c, d, e, f) for a, b, c, d, e, f in mined_by_force(rows, [0, 1])]
    assert mine(vecs(rows, schema=schema), [0, 1]) == exact
    assert mine(vecs([(0, [1e300, 0], 1), (1, [1e300, 0], 1), (2, [9e299, 0], 2)], schema=schema), [0]) == []  # both end at the limit


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(2)
    base = B.unit(rng.normal(size=(20, 32))) * 1500
    ints = np.floor(base[rng.integers(20, size=800)] + 20 * rng.normal(size=(800, 32)))
    norm, angle = H.angles(ints)
    low, high = H.bounds(angle[:100], angle, norm[:100], norm)
    exact = ints[:100] @ ints.T
    assert (low <= exact).all() and (exact <= high).all()
    table = pa.table({"id": pa.array(range(800)), "rid": pa.array(range(800)), "label": pa.array(rng.integers(3, size=800)),
                      "norm": pa.array(norm), "dim": pa.array([32] * 800, pa.int32()), "angles": pa.array(H.vectors.packed(angle)),
                      "ints": pa.array(H.vectors.packed(ints.astype(np.int32)))})
    tile = H.Tile(table)
    _, scored = H.best_positives(tile, tile, 5)
    assert scored < 0.25 * 800 * 800 / 3


# ---------------------------------------------------------------- near duplicates

def linked_by_force(rows, threshold=0.93):
    n, ids = len(rows), [r[0] for r in rows]
    fine = [y is not None and bool(v is not None and len(v)) and all(x is not None and math.isfinite(x) for x in v) and any(np.float32(v) != 0)
            for _, v, y in rows]
    units = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if f else None for f, (_, v, _) in zip(fine, rows, strict=True)]
    near = [[j for j in range(n) if j != i and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
             and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in near[k] if j not in seen and not seen.add(j)]
        least = min((ids[j] for j in seen if ids[j] is not None), default=None)
        out.append((ids[i], len(near[i]), least, ids[i] == least))
    return sorted(out, key=repr)


def linked(df, **kw):
    return sorted((tuple(r) for r in B.near_duplicates(df, **kw).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def copies(n, groups, noise, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    for size in groups:
        base = rng.normal(size=dim)
        rows += [base + noise * np.linalg.norm(base) / np.sqrt(dim) * rng.normal(size=dim) for _ in range(size)]
    return [(k, v, int(k % 3 == 0 and k < n)) for k, v in enumerate(rows)]


@pytest.mark.parametrize("noise, tile", [(0.05, 2048), (0.05, 32), (0.27, 32)])
def test_near_duplicates_match_brute_force(vecs, monkeypatch, noise, tile):
    """Small tiles: balls and pairs of tiles; noise of 0.27: links near the threshold, which balls don't prove."""
    monkeypatch.setattr(B, "BUCKET", 512 if tile > 1000 else 10_000)
    rows = copies(150, (2, 3, 9, 120), noise)
    assert linked(vecs(rows), tile=tile) == linked_by_force(rows)


def test_near_duplicates_edge_cases(vecs):
    rows = [(1, [1, 0], 1), (1, [1, 0], 1), (2, [2, 0.1], 1), (3, [1, 0], 2), (None, [1, 0.05], 1), (4, None, 1), (5, [], 1), (6, [0, 0], 1),
            (7, [None, 1], 1), (8, [float("nan"), 1], 1), (9, [float("inf"), 1], 1), (10, [1, 0], None), (11, [1, 0, 0], 1), (12, [-1, 0], 1),
            (None, [0, 1], 5), (13, [0.0, 3], 5), (14, [1e-30, 0], 1), (15, [1e38, 0], 1)]
    got = [(a, n, c, k if a is not None else None) for a, n, c, k in linked(vecs(rows))]
    assert sorted(got, key=repr) == sorted(((a, n, c, k if a is not None else None) for a, n, c, k in linked_by_force(rows)), key=repr)
    assert linked(vecs([])) == []


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(4)
    x = B.unit(rng.normal(size=(300, 64)))
    y = B.unit(x + 0.05 * rng.normal(size=(300, 64)))
    code, factor = B.encode(x)
    guess, error = B.estimates(code, factor, y)
    off = guess - x @ y.T
    assert abs(off.mean()) < 0.01 and (np.abs(off) <= error[:, None]).mean() > 0.999


def test_index_recall_and_bounded_buckets():
    """Pairs at the threshold share a key, over the sizes for which keys get longer."""
    rng = np.random.default_rng(5)
    x = B.unit(rng.normal(size=(2000, 64)))
    across = B.unit(rng.normal(size=(2000, 64)))
    across = B.unit(across - (across * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * across
    for n in (600, 5_000, 300_000):
        bits = B.bits_of(n)
        tables = B.tables_of(bits, 0.93)
        assert n / 2 ** bits <= B.BUCKET
        assert (B.keys_of(x, bits, tables) == B.keys_of(y, bits, tables)).any(axis=1).mean() > 0.985
