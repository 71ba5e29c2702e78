"""Benchmark decontamination with an FM-index per training shard.

A shard is one Arrow batch of documents.  Words outside the benchmark's
vocabulary cannot be part of a phrase; they separate *runs* of vocabulary
words, and runs shorter than the shortest phrase cannot hold one.  The index
covers all other runs of the shard: a suffix order by prefix doubling (every
run's end is a separator of its own, so no comparison passes it), the
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at
run starts and every ``SAMPLE`` words.  All phrases are searched at once,
backward, by wavelet ranks; occurrences are located by LF steps to a sampled
position, and overlapping ones merge into removal spans.

The benchmark is the query set.  Its phrases travel to the tasks in slices of
at most ``SLICE_BYTES`` of item text; each slice searches all documents, which
carry the spans found so far, and only one slice is in the tasks' memory at a
time, so a benchmark of any size works.

Defined cases: null text has no words; a null item or one without words never
occurs; a null item_id is listed as None; items repeating
an item_id are one item; an empty benchmark hits nothing; rows repeating a
doc_id, or without one, each come out as rows of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.llm.store import Scratch

WINDOW = 10
SAMPLE = 8
SLICE_BYTES = 32 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # A-Z count too: spans refer to the text before lower-casing

#: UTF-8 bytes: A-Z to a-z, other ASCII than 0-9 and a-z to a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Phrases:
    """The windows of a slice of items, over the item words' ids (from 1)."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1) if m else ():
                found.setdefault(tuple(ids[i:i + m]), set()).add(item_id)
        self.items = [sorted(s, key=str) for s in found.values()]
        self.length = np.array([len(p) for p in found], np.int64)
        self.shortest = int(self.length.min()) if found else 0
        wide = int(self.length.max()) if found else 0
        # last word first; 0 fills up shorter phrases
        self.backward = np.array([p[::-1] + (0,) * (wide - len(p)) for p in found], np.int64).reshape(len(found), wide)


class WaveletMatrix:
    """rank(c, i): how often c occurs in seq[:i], for arrays of c and i."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for level in range(self.bits):
            one = (c >> (self.bits - 1 - level)) & 1 == 1
            r, s = self.ones[level][i], self.ones[level][start]
            i = np.where(one, self.zeros[level] + r, i - r)
            start = np.where(one, self.zeros[level] + s, start - s)
        return i - start


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; symbol 0 is a separator, each one smaller than all words and
    than the separators after it."""
    n = len(seq)
    seps = seq == 0
    rank = np.where(seps, np.cumsum(seps) - 1, seq + int(seps.sum()))
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while True:
        # suffixes whose first `step` words are not unique yet, in order
        tied = ~(first & np.concatenate((first[1:], [True])))
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        group, after = rank[who], rank[np.minimum(who + step, n - 1)]
        by = np.lexsort((after, group))
        who, group, after = who[by], group[by], after[by]
        order[at] = who
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        first[at] = new
        rank[who] = np.maximum.accumulate(np.where(new, at, 0))
        step *= 2


class FMIndex:
    """Over a sequence of word ids with separators 0, which starts and ends with a separator."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        sa = suffix_order(seq)
        self.bwt = seq[sa - 1]  # the last separator precedes the first: a separator either way
        self.tree = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma + 1))))
        # sampled: run starts, so that no LF step crosses a separator, and every sample-th word
        self.sampled = (self.bwt == 0) | (sa % sample == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.positions = sa[self.sampled]
        self.n = len(seq)

    def search(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of all phrases."""
        lo = np.zeros(len(p.length), np.int64)
        hi = np.full(len(p.length), self.n, np.int64)
        for step in range(p.backward.shape[1]):
            live = np.flatnonzero((hi > lo) & (step < p.length))
            if not len(live):
                break
            c = p.backward[live, step]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, back = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            r = rows[open_]
            done = self.sampled[r]
            out[open_[done]] = self.positions[self.place[r[done]]] + back[open_[done]]
            open_, r = open_[~done], r[~done]
            c = self.bwt[r]
            rows[open_] = self.before[c] + self.tree.rank(c, r)
            back[open_] += 1
        return out


def occurrences(docs: list[list[bytes]], p: Phrases):
    """Per document: number of words; then (document, first word, phrase) of every occurrence."""
    n_words = np.array([len(d) for d in docs], np.int64)
    none = np.empty(0, np.int64)
    if not len(p.length):
        return n_words, none, none, none
    get = p.vocab.get
    # every document's words, each document closed by a separator
    ids = np.fromiter((i for d in docs for i in (*map(get, d, (0,) * len(d)), 0)), np.int64, int(n_words.sum()) + len(docs))
    edge = np.flatnonzero(np.concatenate(([1], (ids[1:] == 0) != (ids[:-1] == 0))))
    size = np.diff(np.append(edge, len(ids)))
    runs = (ids[edge] != 0) & (size >= p.shortest)
    start, size = edge[runs], size[runs]
    if not len(start):
        return n_words, none, none, none
    # runs one after another, a separator before each and at the end
    shift = np.cumsum(np.concatenate(([1], size[:-1] + 1)))  # where each run begins in the indexed sequence
    seq = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    seq[np.repeat(shift, size) + inside] = ids[np.repeat(start, size) + inside]
    index = FMIndex(seq, len(p.vocab))
    lo, hi = index.search(p)
    hits = hi - lo
    phrase = np.repeat(np.arange(len(hits)), np.maximum(hits, 0))
    if not len(phrase):
        return n_words, none, none, none
    rows = np.repeat(lo, hits) + np.arange(len(phrase)) - np.repeat(np.cumsum(hits) - hits, hits)
    at = index.locate(rows)
    run = np.searchsorted(shift, at, side="right") - 1
    word = start[run] + at - shift[run]
    begins = np.concatenate(([0], np.cumsum(n_words + 1)[:-1]))
    doc = np.searchsorted(begins, word, side="right") - 1
    return n_words, doc, word - begins[doc], phrase


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of the word ranges [first, last), ascending."""
    by = np.argsort(first, kind="stable")
    first, last = first[by], np.maximum.accumulate(last[by])
    new = np.concatenate(([True], first[1:] > last[:-1]))
    ends = np.append(last[:-1][new[1:]], last[-1])
    return list(zip(first[new].tolist(), ends.tolist()))


HITS = "doc_id long, n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, item_ids array<string>"
CARRIED = HITS + ", text string"  # between slices


def _search(bc, schema: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p: Phrases = bc.value
        for batch in batches:
            texts = batch["text"].tolist()
            n_words, doc, first, phrase = occurrences([words_of(t) for t in texts], p)
            spans, items = [[] for _ in texts], [[] for _ in texts]
            by = np.argsort(doc, kind="stable")
            cuts = np.flatnonzero(np.diff(doc[by], prepend=-1))
            for some in np.split(by, cuts[1:]) if len(by) else ():
                d = int(doc[some[0]])
                places = [m.span() for m in WORD.finditer(texts[d])]
                spans[d] = [(a, b, places[a][0], places[b - 1][1])
                            for a, b in _merged(first[some], first[some] + p.length[phrase[some]])]
                items[d] = sorted({str(i) for f in set(phrase[some].tolist()) for i in p.items[f]})
            if "spans" in batch:  # of the slices before
                spans = [_joined(x, y) for x, y in zip(batch["spans"], spans)]
                items = [sorted({*x, *y}) for x, y in zip(batch["item_ids"], items)]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_words": n_words, "spans": spans, "item_ids": items})
            yield out if schema == HITS else out.assign(text=batch["text"])
    return run


def _joined(have, found: list[tuple]) -> list[tuple]:
    """Spans of one document from several slices, merged."""
    out = []
    for a, b, c, d in sorted([tuple(s[k] for k in ("first", "last", "start", "end")) for s in have] + found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2], max(d, out[-1][3]))
        else:
            out.append((a, b, c, d))
    return out


def _without_hits(bc, at: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            _, doc, _, _ = occurrences([words_of(t) for t in batch.column(at).to_pylist()], bc.value)
            keep = np.ones(batch.num_rows, bool)
            keep[doc] = False
            yield batch.filter(pa.array(keep))
    return run


def _slices(benchmark: DataFrame, window: int, slice_bytes: int) -> list:
    """The items' phrases as broadcasts of at most about slice_bytes of item text each."""
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // slice_bytes))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(Phrases([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], window))
            for k in range(n)]


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Every document: doc_id, n_words, spans (word ranges and code-point offsets of what any benchmark
    window covers) and item_ids (as strings, sorted)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    *more, last = _slices(benchmark, window, slice_bytes)
    scratch = Scratch(docs.sparkSession, "removal") if more else None
    saved = None
    for bc in more:
        before, saved = saved, scratch.save(docs.mapInPandas(_search(bc, CARRIED), CARRIED))
        if before is not None:
            scratch.drop(before)
        docs = saved
    return docs.mapInPandas(_search(last, HITS), HITS)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs, all columns, without those that a benchmark window occurs in."""
    at = docs.columns.index("text")
    *more, last = _slices(benchmark, window, slice_bytes)
    scratch = Scratch(docs.sparkSession, "clean") if more else None
    saved = None
    for bc in more:  # written between slices, so that a task holds one of them
        before, saved = saved, scratch.save(docs.mapInArrow(_without_hits(bc, at), docs.schema))
        bc.unpersist()
        if before is not None:
            scratch.drop(before)
        docs = saved
    return docs.mapInArrow(_without_hits(last, at), docs.schema)


def items_sha256(ids: F.Column) -> F.Column:
    return F.sha2(F.array_join(ids, ","), 256)


def brute_force(text: str | None, items: list[tuple], window: int = WINDOW) -> tuple:
    """(n_words, n_hit, item ids) by direct comparison; for tests."""
    w = words_of(text)
    hit, got = set(), set()
    for item_id, t in items:
        iw = words_of(t)
        m = min(window, len(iw))
        for i in range(len(iw) - m + 1) if m else ():
            for j in range(len(w) - m + 1):
                if w[j:j + m] == iw[i:i + m]:
                    hit.update(range(j, j + m))
                    got.add(str(item_id))
    return len(w), len(hit), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), len(got)
