"""Toxicity, language, personal data and decontamination: exact checks and held-out accuracy."""

import random
import re

import numpy as np
import pytest
from llm_paths import SF01
from pyspark.sql import functions as F

from reelrank.llm import crf_toxicity as crf
from reelrank.llm import fm_index, hd_language, sanitise
from reelrank.llm.queries import REGISTRY


# ---------------------------------------------------------------- CRF

def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    x, trans, start = rng.uniform(0.2, 4, 7), rng.uniform(0.3, 3, (2, 2)), rng.uniform(0.5, 2, 2)
    first = np.array([1, 0, 0, 1, 1, 0, 0], bool)  # three documents in one chain
    want = np.zeros(7)
    for lo, hi in ((0, 3), (3, 4), (4, 7)):
        total = 0.0
        for path in np.ndindex(*(2,) * (hi - lo)):
            w = start[path[0]] * (x[lo] if path[0] else 1)
            for k in range(1, hi - lo):
                w *= trans[path[k - 1], path[k]] * (x[lo + k] if path[k] else 1)
            total += w
            want[lo:hi] += w * np.array(path)
        want[lo:hi] /= total
    assert np.allclose(crf.marginals(x, first, trans, start), want)


def test_toxicity_on_held_out_documents(spark):
    sf = SF01.replace("0.01", "0.1")
    got = REGISTRY["op1_toxicity_crf"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    lab = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null")
    n = {(r[0], r[1]): r[2] for r in got.filter("held_out").join(lab, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.95
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_spans_and_edges(spark, make, empty):
    docs = [(i, f"some w{i} words you scum w{i % 7} here") for i in range(60)] + [(i, f"some w{i} fine w{i % 5} words here") for i in range(60, 200)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(200)] + [(0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    more = [(900, None), (901, ""), (902, "İ you SCUM, scum!"), (902, "İ you SCUM, scum!"), (903, "..."), (904, "fine " * 30_000 + "scum scum scum")]
    tagger = crf.train(make(docs), labels, F.lit(True))
    got = [(r.doc_id, r.score, [tuple(s) for s in r.spans]) for r in crf.score_documents(make(docs + more), tagger).collect()]
    by = {i: (s, p) for i, s, p in got}
    assert len(got) == 206 and all((s >= 0.5) == (i < 60) for i, s, _ in got if i < 200)
    # "you" stands in toxic documents only, so it marks them too; "İ" is longer in lower case
    assert [more[2][1][a:b] for a, b in by[902][1]] == ["you SCUM, scum"]
    assert by[900] == by[901] == by[903] and by[900][0] < 0.5
    assert len(by[904][1]) >= 1
    kept = crf.keep_clean(make(docs + more), tagger)
    assert kept.columns == make(docs).columns and {900, 901, 903} <= {r.doc_id for r in kept.collect()}
    assert crf.score_documents(empty, crf.train(empty, labels, F.lit(True))).count() == 0
    none = crf.train(make(docs), labels.filter("toxic = 0"), F.lit(True))
    assert crf.score_documents(make(docs), none).filter("score != 0").count() == 0


# ---------------------------------------------------------------- language

def test_language_on_held_out_documents(spark):
    got = REGISTRY["op6_language_hd"](spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(docs, "doc_id")
    assert held.filter("lang = lang_pred").count() > 0.97 * held.count()


def test_language_edges(make, empty):
    train = make([(1, "the cat and the hat", "en"), (2, "der hund und die katze", "de"), (3, "x", None)])
    protos = hd_language.prototypes(train)
    assert list(protos) == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 .-"), (4, "The hat and the cat"), (4, "The hat and the cat"), (5, "und der die " * 9000)]
    got = sorted((r.doc_id, r.lang_pred, r.score > 0) for r in hd_language.predict(make(rows), protos).collect())
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True), (5, "de", True)]
    assert {r.lang_pred for r in hd_language.predict(make(rows), hd_language.prototypes(empty)).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    b = hd_language.Bundler(64)
    la = {c: b.letter(ord(c)).astype(int) for c in " ab"}
    tri = lambda s: np.roll(la[s[0]], 2) * np.roll(la[s[1]], 1) * la[s[2]]
    assert (b.vector("ab..AB") == 2 * tri(" ab") + 2 * tri("ab ") + tri("b a")).all()


# ---------------------------------------------------------------- personal data

def base_by_regex(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(v if k % 2 == 0 else (2 * v - 9 if 2 * v > 9 else 2 * v) for k, v in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    bits = ["a@b.c", "x.y+z@d-e.fr", "@", "a@", ".com", "1.2.3.4", "999.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (555) 010-9999", "+49", "7", ".", " ", "é", "a@b", "@c.d", "12", "5.6", "--"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert sanitise.base_spans(text) == base_by_regex(text), text
    assert sanitise.base_spans("1" * 200_000) == []


@pytest.mark.parametrize("slice_size", [2_000_000, 2])  # 2: several passes
def test_terms_that_reveal_an_entity_are_found(make, slice_size):
    rng = random.Random(1)
    fill = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4))
    rows = [(i, f"{fill()} Zorvath wrote from zorvath@corp.example {fill()} the") for i in range(6)]
    rows += [(100 + i, f"the {fill()} the {fill()}") for i in range(200)]
    rows += [(900, "Met Zorvath today"), (901, None), (902, ""), (902, "")]
    got = {r.doc_id: r for r in sanitise.find_spans(make(rows), slice_size).collect()}
    assert [(s.kind, rows[0][1][s.start:s.end]) for s in got[0].spans] == [
        ("email", "zorvath@corp.example"), ("term", "Zorvath"), ("term", "wrote"), ("term", "from")]
    assert [s.kind for s in got[900].spans] == ["term"] and got[901].spans == []
    clean = {r.doc_id: r.text for r in sanitise.sanitise(make(rows)).collect()}
    assert "orvath" not in clean[0] and "<EMAIL>" in clean[0] and clean[901] is None and clean[902] == ""


def test_terms_far_from_an_entity_and_fixed_signatures_are_found(make):
    rng = random.Random(2)
    fill = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    # the name is near the address in 2 of 10 documents; the signature's neighbourhood never changes
    far = [(i, f"Zorvath {fill(30 if i > 1 else 2)} zorv@corp.example {fill(9)}") for i in range(10)]
    signed = [(100 + i, f"{fill(20)} Quillon Brasko Head Of Eastern Sales Desk qb@firm.example") for i in range(8)]
    copies = [(200 + i, f"Umbrelo {' '.join('abcdefgh')} um@copy.example") for i in range(9)]
    rows = far + signed + copies + [(1000 + i, fill(12)) for i in range(400)]
    got = {r.doc_id: [(s.kind, r.text[s.start:s.end]) for s in r.spans] for r in sanitise.find_spans(make(rows)).collect()}
    assert all(got[i] == [("email", "zorv@corp.example"), ("term", "Zorvath")] for i in range(10))
    names = ["Quillon", "Brasko", "Head", "Eastern", "Sales", "Desk"]
    assert all(got[100 + i] == [("email", "qb@firm.example"), *[("term", w) for w in names]] for i in range(8))
    assert all(got[200 + i] == [("email", "um@copy.example")] for i in range(9))  # one text, copied


def test_sanitise_empty_table(empty):
    assert sanitise.find_spans(empty).count() == 0


# ---------------------------------------------------------------- decontamination

@pytest.mark.parametrize("slice_bytes", [1 << 25, 60])  # 60: several slices, merged
def test_removal_spans_match_brute_force(spark, make, empty, slice_bytes):
    rng = random.Random(7)
    w = lambda n, v=12: [f"W{rng.randrange(v)}" if rng.random() < 0.2 else f"w{rng.randrange(v)}é" for _ in range(n)]
    items = [(i, " ".join(w(rng.choice([3, 9, 10, 14, 25])))) for i in range(20)] + [(50, None), (51, ""), (7, "one two"), (None, "lone item")]
    rows = [(i, "-".join(w(rng.randrange(60))) + " " + rng.choice(items[:20])[1] + "." + " ".join(w(rng.randrange(30)))) for i in range(60)]
    rows += [(90, None), (91, ""), (92, "the the " * 5000), (93, "a one two, LONE item"), (94, "w1é " * 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in fm_index.removal_spans(make(rows), bench, slice_bytes=slice_bytes).collect():
        text = dict(rows)[r.doc_id]
        n_hit = sum(s["last"] - s["first"] for s in r.spans)
        assert all(len(fm_index.words_of(text[s["start"]:s["end"]])) == s["last"] - s["first"] for s in r.spans)
        import hashlib
        got[r.doc_id] = (r.n_words, n_hit, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), len(r.item_ids))
    assert got == {i: fm_index.brute_force(t, [(str(k), x) for k, x in items]) for i, t in rows}
    kept = fm_index.keep_uncontaminated(make(rows), bench, slice_bytes=slice_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in sorted(got) if got[i][1] == 0]
    assert fm_index.removal_spans(empty, bench).count() == 0
    assert fm_index.removal_spans(make(rows), bench.limit(0)).filter("size(spans) > 0").count() == 0


@pytest.mark.parametrize("slice_bytes", [1 << 25, 60])
def test_removal_spans_keep_rows_with_repeated_and_null_ids(spark, make, slice_bytes):
    rng = random.Random(8)
    w = lambda n: [f"w{rng.randrange(12)}" for _ in range(n)]
    items = [(i, " ".join(w(rng.choice([4, 10, 14])))) for i in range(15)]
    # ids 0 to 4 and none, with different texts and with copies
    rows = [(i % 6 if i % 6 < 5 else None, " ".join(w(i % 7) + [rng.choice(items)[1]] + w(i % 5))) for i in range(48)]
    rows += rows[:9] + [(None, None), (None, None), (3, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert slice_bytes > 60 or len(fm_index._slices(bench, 10, slice_bytes)) > 5
    got = [(r.doc_id, r.n_words, sum(s["last"] - s["first"] for s in r.spans), r.item_ids)
           for r in fm_index.removal_spans(make(rows), bench, slice_bytes=slice_bytes).collect()]
    want = [(i, *fm_index.brute_force(t, items)) for i, t in rows]
    import hashlib
    got = [(i, n, hit, hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids)) for i, n, hit, ids in got]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(2)
    seq = np.concatenate(([0], rng.integers(0, 4, 300), [0]))
    seps = np.cumsum(seq == 0)
    named = [(0, int(seps[i])) if s == 0 else (1, int(s)) for i, s in enumerate(seq)]
    want = sorted(range(len(seq)), key=lambda i: named[i:])
    assert fm_index.suffix_order(seq).tolist() == want
    tree = fm_index.WaveletMatrix(seq, 2)
    for c in range(4):
        i = rng.integers(0, len(seq) + 1, 20)
        assert tree.rank(np.full(20, c), i).tolist() == [int((seq[:k] == c).sum()) for k in i]
