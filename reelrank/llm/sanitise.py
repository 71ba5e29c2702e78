"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers that fixed patterns find.  A *term* (a word of ``MIN_LETTERS`` letters
or more) reveals an entity in so far as documents with the term are documents
with the entity: normalised pointwise mutual information over the corpus,

    npmi(t, e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(t, e)),

with n counting documents: n(t, e) those that hold both, wherever the term
stands.  Pairs in at least ``MIN_TEXTS`` different texts (so that copies of one
text count once) are candidates; from ``GENERALISE`` on all occurrences of the
term are generalised, from ``REMOVE`` on removed.

Candidates and flagged terms travel to the tasks in slices of at most
``SLICE`` hashes, one pass over the documents a slice; a corpus with more only
needs more passes.  Of documents only hashes are shuffled: their entities, and
the distinct terms of those with an entity in ``MIN_TEXTS`` texts; the pairs of
one document are its entities times its terms.

Defined cases: null text is empty; a pattern's match that fails its check is
dropped without a retry; an entity or term in one document only reveals
nothing; rows repeating a doc_id count as documents of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.llm.store import Scratch

MIN_LETTERS = 3
MIN_TEXTS = 3
GENERALISE, REMOVE = 0.8, 0.95
SLICE = 2_000_000

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.  The look-behind of ``ip`` changes no match (a match takes all digits of its run) but
#: keeps long digit runs linear; e-mail addresses are matched around each "@" for the same reason.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{%d,}" % MIN_LETTERS)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed in KINDS, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _hash(s: str) -> int:
    """Signed 64 bits."""
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _entities(text: str) -> list[int]:
    """Hashes of the different entities of a text."""
    found = set()
    for kind, a, b in base_spans(text):
        value = text[a:b].lower()
        found.add(_hash(f"{kind}:{value if kind in ('email', 'ip') else _digits(value)}"))
    return list(found)


def _mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(e, h) for text in batch["text"] if (found := _entities(text)) for h in [_hash(text)] for e in found]
        yield pd.DataFrame(rows, columns=["entity", "text"], dtype="int64")


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(found, _hash(text), [_hash(w) for w in set(_TERM.findall(text.lower()))])
                for text in batch["text"] if (found := _entities(text))]
        yield pd.DataFrame(rows, columns=["entities", "text", "terms"])


def _slices(df: DataFrame, column: str, size: int):
    """The distinct values of a hash column as sorted arrays of about ``size`` at most."""
    n = -(-df.select(column).distinct().count() // size)
    for k in range(n):
        part = df if n == 1 else df.filter(F.pmod(F.xxhash64(column), F.lit(n)) == k)
        hashes = np.sort(part.select(column).distinct().toPandas()[column].to_numpy(np.int64))
        if len(hashes):
            yield hashes


class _Known:
    """Which words are in a sorted hash array; keeps the answers of up to 300,000 words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.seen = hashes, {}

    def __call__(self, words: list[str]) -> None:
        new = list(set(words).difference(self.seen))
        if len(self.seen) + len(new) > 300_000:
            self.seen, new = {}, list(set(words))
        h = np.array([_hash(w) for w in new], np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        self.seen.update(zip(new, np.where(self.hashes[at] == h, h, 0).tolist()))  # 0: not in it


def _count_rows(bc):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = _Known(bc.value), {}
        for batch in batches:
            for text in batch["text"]:
                words = list(set(_TERM.findall(text.lower()))) if text else []
                known(words)
                for h in {known.seen[w] for w in words} - {0}:
                    counts[h] = counts.get(h, 0) + 1
        yield pd.DataFrame({"term": np.array(list(counts), np.int64), "n": np.array(list(counts.values()), np.int64)})
    return run


def disclosing_terms(docs: DataFrame, scratch: Scratch, slice_size: int = SLICE) -> DataFrame:
    """(term hash, npmi): terms at GENERALISE or more for some entity, with their largest npmi."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    n_docs = text.count()
    mentions = text.mapInPandas(_mentions, "entity long, text long").groupBy("entity", "text").agg(F.count("*").alias("n"))
    entities = scratch.save(mentions.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts")).filter(
        F.col("texts") >= MIN_TEXTS).select("entity", "n_e"))
    if entities.isEmpty():
        return docs.sparkSession.createDataFrame([], "term long, npmi double")
    # every entity's different texts once, with the number of documents they stand for
    held = text.mapInPandas(_documents, "entities array<long>, text long, terms array<long>")
    held = held.select(F.explode("entities").alias("entity"), "text", "terms").join(entities, "entity", "left_semi")
    held = held.groupBy("entity", "text").agg(F.first("terms").alias("terms"), F.count("*").alias("n"))
    pairs = held.select("entity", F.explode("terms").alias("term"), "n").groupBy("entity", "term").agg(
        F.sum("n").alias("n_te"), F.count("*").alias("texts")).filter(F.col("texts") >= MIN_TEXTS)
    pairs = scratch.save(pairs.select("entity", "term", "n_te"))
    parts, bc = [], None
    for hashes in _slices(pairs, "term", slice_size):
        if bc is not None:  # written between slices, so that a task holds one of them
            parts[-1] = scratch.save(parts[-1])
            bc.unpersist()
        bc = docs.sparkSession.sparkContext.broadcast(hashes)
        parts.append(text.mapInPandas(_count_rows(bc), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t")))
    if not parts:
        return docs.sparkSession.createDataFrame([], "term long, npmi double")
    counts = reduce(DataFrame.unionByName, parts)
    rows = pairs.join(counts, "term").join(entities, "entity")
    pmi = F.log(F.lit(float(n_docs)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    most = F.log(F.lit(float(n_docs)) / F.col("n_te"))
    npmi = F.when(most > 0, pmi / most).otherwise(0.0)
    return scratch.save(rows.select("term", npmi.alias("npmi")).filter(F.col("npmi") >= GENERALISE).groupBy("term").agg(
        F.max("npmi").alias("npmi")))


SPANS = "doc_id long, text string, spans array<struct<kind:string,start:long,end:long,action:string>>"


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans = [[(k, a, b, "generalise") for k, a, b in base_spans(t)] for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"], "spans": spans})


def _find_terms(bc):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, remove = bc.value
        known = _Known(hashes)
        for batch in batches:
            spans = []
            for text, have in zip(batch["text"], batch["spans"]):
                have = [tuple(s[k] for k in ("kind", "start", "end", "action")) for s in have]
                words = list(set(_TERM.findall(text.lower()))) if text else []
                known(words)
                if any(known.seen[w] for w in words):
                    for m in _TERM.finditer(text):
                        w = m[0].lower()
                        if w not in known.seen:
                            known([w])
                        h = known.seen[w]
                        if h and not any(a < m.end() and m.start() < b for k, a, b, _ in have if k in KINDS):
                            act = "remove" if remove[np.searchsorted(hashes, h)] else "generalise"
                            have.append(("term", *m.span(), act))
                    have.sort(key=lambda s: (len(KINDS), s[1]) if s[0] == "term" else (KINDS.index(s[0]), s[1]))
                spans.append(have)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"], "spans": spans})
    return run


def find_spans(docs: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """Every document: doc_id, text and spans (base kinds as listed, then terms by start) with what to do."""
    scratch = Scratch(docs.sparkSession, "sanitise")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = disclosing_terms(rows, scratch, slice_size)
    out, saved, bc = rows.mapInPandas(_find, SPANS), None, None
    for hashes in _slices(terms, "term", slice_size):
        if bc is not None:  # written between slices, so that a task holds one of them
            before, saved = saved, scratch.save(out)
            bc.unpersist()
            if before is not None:
                scratch.drop(before)
            out = saved
        removed = terms.filter(F.col("npmi") >= REMOVE).select("term").distinct()
        removed = removed.filter(F.col("term").between(int(hashes[0]), int(hashes[-1]))).toPandas()["term"].to_numpy(np.int64)
        bc = docs.sparkSession.sparkContext.broadcast((hashes, np.isin(hashes, removed)))
        out = out.mapInPandas(_find_terms(bc), SPANS)
    return out


def sanitised(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text with spans generalised to <KIND> or removed; overlapping spans merge into the first."""
    out, at = [], 0
    for kind, a, b, act in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a])
            out.append(f"<{kind.upper()}>" if act == "generalise" else "")
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text with personal data generalised or removed, and the spans of the original."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if t is None else sanitised(t, [tuple(s[k] for k in ("kind", "start", "end", "action")) for s in spans])
                     for t, spans in zip(batch["text"], batch["spans"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "spans": batch["spans"]})
    return find_spans(docs).mapInPandas(run, SPANS)
