"""Toxic spans by a linear-chain conditional random field.

Training.  A bounded sample of labelled documents (``MAX_TOXIC`` and
``MAX_CLEAN``, by hash of doc_id, none over ``MAX_CHARS`` code points) is
brought to the driver; counts of all labelled rows give the class weights.
Document labels become token labels: in a toxic document a word is labelled
toxic if it or a prefix of it occurs in toxic documents far more often than
chance (``MIN_Z``, ``MIN_RATE``); all other words are clean.  A two-state CRF
with hashed word, prefix and suffix features is fitted to these tokens, and a
logistic function of the document's marginals to the document labels.

Scoring.  Forward-backward over whole documents gives each word's marginal;
the document score is the logistic function of their maximum, sum and rate,
and words at ``SPAN_AT`` or more, joined where adjacent, are the offending
offsets.  Only the text enters a score.

A batch of documents is one chain: a document's first word has the start
probabilities whatever came before, so the recursions of all documents run
together, in blocks that are multiplied up first.

Defined cases: texts that are null, empty or without words score as a document
with no toxic word; without both labels in the sample every score is the
share of toxic labels (0 without any); rows repeating a doc_id in the labels
count once, with the larger label.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1000, 2000, 50_000
MIN_Z, MIN_RATE, MIN_DOCS = 5.0, 0.3, 4
BUCKETS = 1 << 18
STEPS = 40
MAX_TOKENS = 300_000     # words of the training windows
WINDOW = 64
SPAN_AT = 0.5
GROUP_WORDS = 150_000    # words scored together
SLICE_ROWS = 500         # documents of a batch scored at a time
CACHE = 300_000

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def prefixes(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in range(4, min(8, len(word))))]


def features(word: str) -> list[int]:
    names = [*prefixes(word), *("*" + word[-n:] for n in (3, 4) if len(word) > n), "bias"]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


# ---------------------------------------------------------------- the chain

def forward_backward(x: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """alpha and beta (n, 2), each row scaled to sum 1, for a chain with emission odds ``x`` of state 1,
    transition factors ``trans`` (2, 2) and ``start`` factors where ``first``."""
    n = len(x)
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    pad = blocks * size - n
    x = np.append(x, np.ones(pad)).reshape(blocks, size)
    first = np.append(first, np.ones(pad, bool)).reshape(blocks, size)
    m = np.empty((size, 4, blocks))  # m[k, 2i+j]: from state i to j at the k-th word of every block
    for i in range(2):
        m[:, 2 * i] = np.where(first, start[0], trans[i, 0]).T
        m[:, 2 * i + 1] = (np.where(first, start[1], trans[i, 1]) * x).T
    prod = np.zeros((4, blocks))
    prod[0] = prod[3] = 1.0
    for k in range(size):
        a, b, c, d = prod
        e, f, g, h = m[k]
        prod = np.stack((a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h))
        prod /= prod.max(axis=0)
    enter, leave = np.empty((blocks, 2)), np.empty((blocks, 2))
    v, p = (0.5, 0.5), prod.T.tolist()
    for k in range(blocks):
        enter[k] = v
        a, b, c, d = p[k]
        v = (v[0] * a + v[1] * c, v[0] * b + v[1] * d)
        v = (v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1]))
    v = (0.5, 0.5)
    for k in range(blocks - 1, -1, -1):
        leave[k] = v
        a, b, c, d = p[k]
        v = (a * v[0] + b * v[1], c * v[0] + d * v[1])
        v = (v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1]))
    alpha, beta = np.empty((size, 2, blocks)), np.empty((size, 2, blocks))
    a0, a1 = enter.T
    for k in range(size):
        e, f, g, h = m[k]
        a0, a1 = a0 * e + a1 * g, a0 * f + a1 * h
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        alpha[k, 0], alpha[k, 1] = a0, a1
    b0, b1 = leave.T
    for k in range(size - 1, -1, -1):
        beta[k, 0], beta[k, 1] = b0, b1
        e, f, g, h = m[k]
        b0, b1 = e * b0 + f * b1, g * b0 + h * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    flat = lambda z: z.transpose(2, 0, 1).reshape(-1, 2)[:n]
    return flat(alpha), flat(beta)


def marginals(x, first, trans, start) -> np.ndarray:
    alpha, beta = forward_backward(x, first, trans, start)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1)


# ---------------------------------------------------------------- training

def token_lexicon(docs: list[list[str]], toxic: np.ndarray, weight: np.ndarray) -> set[str]:
    """Words and prefixes that mark toxic documents."""
    bad = Counter()
    for d, t in zip(docs, toxic):
        if t:
            bad.update({u for x in set(d) for u in prefixes(x)})
    bad = {u: n for u, n in bad.items() if n >= MIN_DOCS}
    all_ = Counter()
    for d, w in zip(docs, weight):
        for u in {u for x in set(d) for u in prefixes(x) if u in bad}:
            all_[u] += w
    share = float((weight * toxic).sum() / weight.sum())
    scale = float(weight[toxic == 1][0]) if toxic.any() else 1.0
    out = set()
    for u, n in bad.items():
        seen, expect = n * scale, all_[u] * share
        if seen >= max(MIN_RATE, 2.5 * share) * all_[u] and (seen - expect) >= MIN_Z * np.sqrt(expect * scale):
            out.add(u)
    return out


def fit_crf(docs: list[list[str]], toxic: np.ndarray, lexicon: set[str]):
    """(feature weights, transition factors, start factors), by Adam on the mean log-likelihood."""
    marked = {w for w in {x for d, t in zip(docs, toxic) if t for x in d} if any(u in lexicon for u in prefixes(w))}
    spots, others = [], []
    for d, t in zip(docs, toxic):
        for a in range(0, len(d), WINDOW):
            some = d[a:a + WINDOW]
            (others if marked.isdisjoint(some) else spots).append((some, t))
    room = max(WINDOW, MAX_TOKENS - WINDOW * len(spots))
    every = max(1, -(-len(others) * WINDOW // room))
    seqs = spots[: MAX_TOKENS // WINDOW] + others[::every]
    known = {w: features(w) for w in {w for s, _ in seqs for w in s}}
    size = np.array([len(known[w]) for s, _ in seqs for w in s])
    feat = np.array([i for s, _ in seqs for w in s for i in known[w]])
    gold = np.array([bool(t and w in marked) for s, t in seqs for w in s], float)
    first = np.array([k == 0 for s, _ in seqs for k in range(len(s))])
    owner = np.repeat(np.arange(len(size)), size)
    inner = np.flatnonzero(~first)
    pair = (2 * gold[inner - 1] + gold[inner]).astype(int)
    seen = np.bincount(pair, minlength=4).astype(float)
    theta = np.zeros(BUCKETS + 6)  # features, four transitions, two starts
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        x = np.exp(np.clip(np.bincount(owner, theta[feat], len(size)), -15, 15))
        trans, start = np.exp(theta[BUCKETS:BUCKETS + 4]).reshape(2, 2), np.exp(theta[BUCKETS + 4:])
        alpha, beta = forward_backward(x, first, trans, start)
        both = alpha * beta
        post = both[:, 1] / both.sum(axis=1)
        joint = np.stack([alpha[inner - 1, i] * trans[i, j] * (x[inner] if j else 1.0) * beta[inner, j]
                          for i in range(2) for j in range(2)])
        joint = (joint / joint.sum(axis=0)).sum(axis=1)
        grad = np.zeros_like(theta)
        grad[:BUCKETS] = np.bincount(feat, np.repeat(gold - post, size), BUCKETS)
        grad[BUCKETS:BUCKETS + 4] = seen - joint
        at = gold[first].sum() - post[first].sum()
        grad[BUCKETS + 4:] = -at, at
        grad = grad / max(1.0, gold.sum()) - 1e-3 * theta
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad ** 2
        theta += 0.25 * (mean / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.99 ** step)) + 1e-6)
    return theta[:BUCKETS], np.exp(theta[BUCKETS:BUCKETS + 4]).reshape(2, 2), np.exp(theta[BUCKETS + 4:])


def summaries(post: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, largest marginal, log of their sum, log of their rate, log of words at SPAN_AT."""
    ends = np.cumsum(lengths)
    run = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v)))[np.concatenate(([0], ends))])
    total = np.maximum(run(post), 0.0)
    top = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        top[some] = np.maximum.reduceat(post, (ends - lengths)[some])
    return np.stack((np.ones(len(lengths)), top, np.log1p(total), np.log1p(1000 * total / np.maximum(1, lengths)) / 4,
                     np.log1p(run(post >= SPAN_AT))), axis=1)


def fit_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 0.5 * np.eye(len(b))
        b = b + np.clip(np.linalg.solve(h, z.T @ (weight * (y - p)) - 0.5 * b), -4, 4)
    return b


class Tagger:
    """What scoring needs; ``model`` is (weights, transitions, starts, logistic) or None with a constant score."""

    def __init__(self, model, share: float = 0.0):
        self.model, self.share, self.known = model, share, {}

    def odds(self, words: list[str]) -> list[float]:
        w = self.model[0]
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, set(words)
        for x in new:
            self.known[x] = float(w[features(x)].sum())
        return list(map(self.known.__getitem__, words))

    def marginals(self, docs: list[list[str]]) -> np.ndarray:
        _, trans, start, _ = self.model
        if not sum(map(len, docs)):
            return np.empty(0)
        x = np.exp(np.clip(np.array([o for d in docs for o in self.odds(d)]), -15, 15))
        first = np.zeros(len(x), bool)
        lengths = np.array([len(d) for d in docs])
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        return marginals(x, first, trans, start)

    def score(self, texts: list[str | None]):
        """Scores and spans (start, end code points) of texts."""
        if self.model is None:
            return [self.share] * len(texts), [[] for _ in texts]
        scores, spans, a = [], [], 0
        while a < len(texts):
            # texts are split as their group is formed: the words of one group are held at a time
            b, n, split = a, 0, []
            while b < len(texts) and (b == a or n < GROUP_WORDS):
                split.append(words_of(texts[b]))
                n += len(split[-1])
                b += 1
            post = self.marginals(split)
            lengths = np.array([len(d) for d in split])
            z = summaries(post, lengths) @ self.model[3]
            scores.extend((1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist())
            ends = np.cumsum(lengths)
            for i, (lo, hi) in enumerate(zip(ends - lengths, ends)):
                bad = np.flatnonzero(post[lo:hi] >= SPAN_AT)
                spans.append(_offsets(texts[a + i], bad) if len(bad) else [])
            a = b
        return scores, spans


def _offsets(text: str, bad: np.ndarray) -> list[tuple[int, int]]:
    """Code-point ranges of the words numbered ``bad``, adjacent ones joined.  Lower-casing can lengthen
    a text, so words are found in the lower-cased text and mapped back letter by letter."""
    low = text.lower()
    places = [m.span() for m in WORD.finditer(low)]
    if len(low) != len(text):
        back = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])[: len(low)].tolist()
        back += [len(text)] * (len(low) + 1 - len(back))
        places = [(back[s], back[e - 1] + 1) for s, e in places]
    out = []
    for k in bad.tolist():
        s, e = places[k]
        if out and out[-1][2] == k - 1:
            out[-1] = (out[-1][0], e, k)
        else:
            out.append((s, e, k))
    return [(s, e) for s, e, _ in out]


def train(docs: DataFrame, labels: DataFrame, in_training, max_toxic=MAX_TOXIC, max_clean=MAX_CLEAN) -> Tagger:
    """Fits the tagger to labelled documents for which ``in_training`` (a Column over doc_id) holds."""
    lab = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(in_training)
    ids = docs.select("doc_id", "text").withColumn("chars", F.coalesce(F.length("text"), F.lit(0)))
    lab = ids.join(lab, "doc_id").groupBy("doc_id", "toxic").agg(F.min("chars").alias("chars"))
    n = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    if not n_bad or not n_good:
        return Tagger(None, n_bad / max(1, n_bad + n_good))
    short = lab.filter(F.col("chars") <= MAX_CHARS).select("doc_id", "toxic")
    pick = lambda t, k: short.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    chosen = pick(1, max_toxic).unionByName(pick(0, max_clean))  # at most max_toxic + max_clean ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    rows = rows.sort_values("doc_id")
    toxic = rows["toxic"].to_numpy(int)
    if len(set(toxic.tolist())) < 2:  # one label occurs in very long texts only
        return Tagger(None, n_bad / (n_bad + n_good))
    pool: dict[str, str] = {}  # one string a distinct word
    words = [[pool.setdefault(w, w) for w in words_of(t)] for t in rows["text"]]
    del rows
    weight = np.where(toxic == 1, n_bad / max(1, toxic.sum()), n_good / max(1, (1 - toxic).sum()))
    lexicon = token_lexicon(words, toxic, weight)
    crf = fit_crf(words, toxic, lexicon)
    tagger = Tagger((*crf, None))
    z = np.concatenate([summaries(tagger.marginals(words[i:i + 100]), np.array([len(d) for d in words[i:i + 100]]))
                        for i in range(0, len(words), 100)])
    b = fit_logistic(z, toxic.astype(float), weight)
    return Tagger((*crf, b))


SCORED = "doc_id long, score double, spans array<struct<start:long,end:long>>"


def score_documents(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Every document: doc_id, score and toxic spans."""
    bc = docs.sparkSession.sparkContext.broadcast((tagger.model, tagger.share))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = Tagger(*bc.value)
        for batch in batches:
            for i in range(0, len(batch), SLICE_ROWS):
                some = batch.iloc[i:i + SLICE_ROWS]
                scores, spans = tag.score(some["text"].tolist())
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "score": scores, "spans": spans})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SCORED)


def keep_clean(docs: DataFrame, tagger: Tagger, below: float = 0.5) -> DataFrame:
    """docs, all columns, without those that score ``below`` or more."""
    bc = docs.sparkSession.sparkContext.broadcast((tagger.model, tagger.share))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        tag = Tagger(*bc.value)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(i, SLICE_ROWS)
                scores, _ = tag.score(some.column(at).to_pylist())
                yield some.filter(pa.array([s < below for s in scores], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
