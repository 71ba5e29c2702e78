"""Exact dedup, Jaccard join and repeated strings against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelrank.llm import exact_dedup, jaccard_join, pfp_dedup


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


# ---------------------------------------------------------------- exact dedup

@given(st.lists(st.integers(0, 2 ** 20 - 1), max_size=200, unique=True), st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values, k):
    v = np.array(sorted(values), np.int64)
    assert exact_dedup.golomb_decode(exact_dedup.golomb_encode(v, 0, k), 0, k).tolist() == sorted(values)


@pytest.mark.parametrize("bits", [48, 8])  # 8 bits: unequal texts share fingerprints, bytes decide
def test_exact_groups_match_brute_force(make, bits):
    rows = [(i, t) for i, t in enumerate(["a b", "ab", "a\tb\n", None, "", " ", "x", "y", "ä b", "äb"] * 3)]
    rows += [(100 + i, f"t{i % 40}") for i in range(120)] + [(5, " "), (None, "x"), (None, "only")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[key])[3]
        want.append((i, keep, len(groups[key]), keep == i, hashlib.sha256(key.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(make(rows), bits=bits, part_rows=20).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_groups_of_empty_table(empty):
    assert exact_dedup.exact_groups(empty).count() == 0


# ---------------------------------------------------------------- Jaccard join

def components_by_force(rows, percent, shingle):
    sets = []
    for i, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
             for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        m = min(shingle, len(w))
        sets.append((i, {tuple(w[j:j + m]) for j in range(len(w) - m + 1)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(a), find(i)) for i, a in sets)


def corpus(seed):
    """Copies, near copies of differing closeness, and a passage that unrelated texts share."""
    rng = random.Random(seed)
    passage, rows = words(rng, 30), []
    for f in range(6):
        base = words(rng, rng.randrange(20, 160))
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
            rows.append(" ".join(w).title() if rng.random() < 0.3 else "  ".join(w))
    for _ in range(40):
        w = words(rng, rng.randrange(1, 80), 10 ** 6)
        at = rng.randrange(len(w))
        rows.append(" ".join(w[:at] + passage + w[at:]))
    rows += ["", None, " \n", "one", "one", "One two", "one two three", "ONE two three"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("rare", [2, 48])  # 2: nearly all tokens are frequent, so runs and blocks do the work
@pytest.mark.parametrize("percent,shingle", [(85, 4), (80, 5)])
def test_components_match_brute_force(make, monkeypatch, rare, percent, shingle):
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 10 if rare == 2 else 500_000)
    rows = corpus(rare + percent)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(make(rows), percent, shingle).collect())
    assert got == components_by_force(rows, percent, shingle)


@pytest.mark.parametrize("percent,shingle", [(85, 4), (80, 5)])
def test_a_shared_passage_makes_no_family(make, monkeypatch, percent, shingle):
    """Unrelated texts with one passage in common leave each other's prefixes once rare tokens come first."""
    def never(_):
        def fail(rows):
            raise AssertionError("whole sets were compared in blocks")
        return fail

    monkeypatch.setattr(jaccard_join, "_spanning", never)
    rng = random.Random(1)
    passage = words(rng, 30)
    rows = [(i, " ".join(words(rng, 40, 10 ** 6) + passage + words(rng, 40, 10 ** 6))) for i in range(300)]
    rows.append((1000, rows[7][1] + " end"))
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(make(rows), percent, shingle).collect())
    assert got == components_by_force(rows, percent, shingle)
    assert got[-1][2] == 7


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_a_run(percent):
    """Any two linked sets, whatever tokens they do not share, have a key of the run index in common."""
    rng = random.Random(percent)

    def keys(tokens):
        a = np.array(sorted(tokens), np.int64)[:jaccard_join.run_length(len(tokens), jaccard_join.K, percent)].view(np.uint64)
        widths = (jaccard_join.K, jaccard_join.K - 1) if len(a) <= jaccard_join.SHORT else (jaccard_join.K,)
        return {k for w in widths for k in jaccard_join._run_keys(a, w).tolist()}

    for n in range(4, 60):
        for own in range(1, n):
            if 100 * (n - own) < percent * n:
                break
            for _ in range(60):
                gone = rng.sample(range(n), own)
                cut = rng.randrange(own + 1)
                x, y = set(range(n)) - set(gone[:cut]), set(range(n)) - set(gone[cut:])
                assert keys(x) & keys(y), (n, gone, cut)



def test_keep_one_keeps_columns_and_clean_rows(make, empty):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "z"), (None, "q r s")]
    kept = jaccard_join.keep_one(make(rows), 80, 5)
    assert kept.columns == make(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, None]
    assert jaccard_join.keep_one(empty).count() == 0


def test_keep_one_with_null_and_clashing_ids(make):
    words = lambda p, n=30: " ".join(f"{p}{i}" for i in range(n))
    a, b, c, d = words("a"), words("b"), words("c"), words("d")
    rows = [(None, a), (None, a + " more"), (5, a), (4, a + " else"),  # copies and near copies of 4, with null ids
            (None, b), (None, b), (None, b + " more"),                 # null ids only
            (7, c), (7, d), (7, d),                                    # two clean texts with one id
            (8, c + " more"), (None, ""), (None, None)]
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(make(rows), 80, 5).collect()]
    texts = [t for _, t in kept]
    assert len(kept) == 6 and {(4, a + " else"), (7, c), (7, d), (None, ""), (None, None)} <= set(kept)
    assert sum(t in (b, b + " more") for t in texts) == 1


# ---------------------------------------------------------------- repeated strings

@pytest.mark.parametrize("length", [200, 30])
def test_repeats_match_brute_force(make, length):
    rng = random.Random(length)
    base = "".join(rng.choice("abcé ") for _ in range(400))
    rows = [(100, None), (101, ""), (101, ""), (102, base), (102, base)]
    for i in range(40):
        t = "".join(rng.choice("abc xyzé") for _ in range(rng.randrange(500)))
        kind = i % 5
        if kind == 0:
            t = "a" * rng.randrange(700)
        elif kind == 1:
            at = rng.randrange(300)
            t += base[at:at + rng.randrange(100, 400)] + t[::-1]
        elif kind == 2:
            t = "ab" * rng.randrange(300) + t
        elif kind == 3:
            t += t
        rows.append((i, t))
    got = sorted((r.doc_id, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                 for r in pfp_dedup.remove_repeats(make(rows), length).collect())
    want = sorted((i, *x) for (i, _), x in zip(rows, pfp_dedup.brute_force([(t or "").encode() for _, t in rows], length)))
    assert got == want


@pytest.mark.parametrize("length", [200, 40])
def test_repeats_of_cutouts_over_many_range_partitions(spark, make, length):
    """Cut-outs of one text: a phrase shares its head with one neighbour and its tail with another, across borders."""
    rng = random.Random(length)
    base = "".join(rng.choice("abcdeé ") for _ in range(900))
    rows = [(200, base[:500] + "\0\0"), (201, base[:500] + "\0")]
    for i in range(120):
        at, own = rng.randrange(900), "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(60)))
        rows.append((i, own + base[at:at + rng.randrange(length // 2, 2 * length)] + own[::-1]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.doc_id, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                     for r in pfp_dedup.remove_repeats(make(rows), length).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = sorted((i, *x) for (i, _), x in zip(rows, pfp_dedup.brute_force([t.encode() for _, t in rows], length)))
    assert got == want


def test_repeats_of_periodic_texts(make):
    rows = [(1, "ab" * 150), (2, "x" + "ab" * 150), (3, "short")]
    got = {r.doc_id: len(r.kept) for r in pfp_dedup.remove_repeats(make(rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 5}


def test_repeats_of_empty_table(empty):
    assert pfp_dedup.remove_repeats(empty).count() == 0
