"""The Merkle manifest against trees built node by node."""

import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelrank.llm import merkle_log as M


def H(s):
    return sha256(s.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700))
def test_closed_form_positions_address_the_completion_order(n):
    tree, top = levels([f"{k:064x}" for k in range(n)]), M.height(n)
    assert len(tree) == top + 1
    log = M.append_log(tree[0], top)
    assert len(log) == sum(map(len, tree))
    assert all(log[M.position(h, i, n, top)] == d for h, level in enumerate(tree) for i, d in enumerate(level))
    for i in {0, n // 2, n - 1}:
        path = M.siblings(log, i, n, top)
        assert M.unpack(M.pack(path)) == path and M.fold(log[M.position(0, i, n, top)], path) == log[-1]


def encode(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def by_force(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaves = lambda r: H("".join(map(encode, r)))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaves(r))) for x in langs]
    trees = [levels([leaves(r) for r in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for j, (g, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            node, others = tree[0][i], []
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = leaves((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for x, climb in ((i, tree), (j, top)):
                for level in climb[:-1]:
                    run, k = level[x // 8 * 8:x // 8 * 8 + 8], x % 8
                    others += run[:k] + run[k + 1:]
                    node, x = H("".join(run[:k] + [node] + run[k + 1:])), x // 8
            out.append((r[0], tree[0][i], tree[-1][0], top[-1][0], H("".join(others)), node, node == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
CASES = {
    "nulls, empty and repeated rows": [(3, "A b", "en", "s"), (3, "A b", "en", "s"), (3, "A c", "en", "s"), (None, "X", "en", None),
                                       (None, None, None, None), (5, "", None, "ü"), (6, "É Z", "É", "s"), (9, "only", "zz", "s")],
    "one row": [(1, "ABC", None, None)],
    "a run of one": [(k, f"Text {k}", "en", "s") for k in range(9)],
    "several rounds, many groups": [(k, f"Text {k}", "en", "s") for k in range(1100)] + [(k, "T", f"l{k % 70}", "s") for k in range(1100, 1300)],
    "a very long text": [(k, "Word " * 400_000 if k == 1 else "w", "en", "s") for k in range(4)],
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_matches_brute_force(make, case):
    docs = make([(i, t, lang, source) for i, t, lang, source in CASES[case]])
    got = M.Manifest(docs, M.lower_cased()).proofs().select(COLUMNS).collect()
    rows = [tuple(r) for r in docs.select(*M.COLUMNS).collect()]
    assert sorted(map(tuple, got), key=repr) == by_force(rows)


def test_log_is_gapless_and_ends_in_the_subroot(make):
    m = M.Manifest(make([(k, f"Text {k}", "en" if k % 5 else None, "s") for k in range(1500)]))
    log = M.log_table(m.rounds).toPandas()
    for tree, part in log.groupby("tree"):
        part = part.sort_values("position")
        n = (part.level == 0).sum()
        assert list(part.position) == list(range(len(part)))
        leaves = part[part.level == 0].sort_values("idx")
        assert list(part.digest) == M.append_log(list(leaves.digest), M.height(n))
    assert m.proofs().filter("not verified").count() == 0


def test_empty_table(empty):
    assert M.Manifest(empty, M.lower_cased()).proofs().count() == 0
