"""Exact n-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct 4-word shingles, as 64-bit hashes in
ascending order (one global order).  Documents with equal sets form a class
and only classes are joined.  With similarity s and a set of n tokens,

* the *prefix* is the first n - ceil(s n) + 1 tokens: linked sets share one of
  them;
* with at most d = (1 - s) n / s tokens in one set only, the first k (d + 1)
  tokens of the union hold k neighbours that both sets have: in the *extended
  prefix* of k (d + 1) tokens, linked sets share a run of k neighbours.  From
  80 percent on, the union is long enough for that but in one case: sets of 4
  and 5 tokens.  Sets of up to 5 tokens are indexed by runs of k - 1 besides.

Prefix tokens held by up to ``RARE`` classes are indexed singly.  If one of two
linked classes has no frequent prefix token, the token they share is rare;
otherwise both are among the classes with a frequent prefix token, which are
indexed again in another order: rare tokens first, by counts of all tokens in
``SLOTS`` counters (any order is right, so counters may be shared).  There a
passage that unrelated texts share comes last and leaves their prefixes.  Again
rare prefix tokens are indexed singly, and only classes that still have a
frequent one (texts made of frequent tokens almost wholly) are indexed by all
runs of ``K`` tokens of their extended prefix: no link is missed.

Buckets are joined in two rounds.  First every member is compared with its
bucket's hub only (the class with most copies, then the smallest id), and the
links found are closed to components.  Only buckets that still hold several
components go on: rare ones (at most ``RARE`` members) by pairs across
components that share enough prefix tokens, run buckets by families (classes
that such buckets connect) in blocks of ``BLOCK``: a pair of blocks compares
its whole sets as matrices and emits no more links than join its components.
Every link is verified on whole sets.

Defined cases: texts that are null or without words have no shingle and are
linked with nothing; a text of fewer than 4 words has its whole sequence as
its shingle; rows repeating a doc_id are one document, linked by any of its
texts; a null doc_id takes part as a copy or partner, with its class's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelrank.llm.graph import components
from reelrank.llm.store import Scratch

SHINGLE = 4
PERCENT = 85
K = 3
SHORT = 5
RARE = 48
SLOTS = 1 << 20  # counters for the second order; a byte each is broadcast
CHUNK = 1 << 16  # counters in a row of the table of signatures
BLOCK = 512
BROADCAST_IDS = 500_000  # id tables of up to so many rows are broadcast to the documents, larger ones joined by shuffle
CACHE = 400_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


class Shingler:
    """Token sets of texts; keeps the hashes of up to CACHE words."""

    def __init__(self, n: int = SHINGLE):
        self.n, self.known = n, {}

    def tokens(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes (int64)."""
        words = words_of(text)
        if not words:
            return np.empty(0, np.int64)
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, set(words)
        for w in new:
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        m = min(self.n, len(h))
        out = np.full(len(h) - m + 1, 0x9E3779B97F4A7C15 + m, np.uint64)
        for i in range(m):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[i:i + len(out)]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return np.unique(out.view(np.int64))


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def needed(nx, ny, percent: int = PERCENT):
    """Smallest intersection of linked sets: 100 i >= percent (nx + ny - i)."""
    return -(-percent * (nx + ny) // (100 + percent))


def run_length(n: int, k: int, percent: int = PERCENT) -> int:
    return k * ((100 - percent) * n // percent + 1)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int64)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))


def _text_batches(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def _signed(percent: int, shingle: int):
    def run(batches):
        s, total = Shingler(shingle), np.zeros(SLOTS, np.int64)
        for b in _text_batches(batches):
            sets = [s.tokens(t) for t in b.column("text").to_pylist()]
            total += np.bincount(np.concatenate(sets) & (SLOTS - 1), minlength=SLOTS) if sets else 0
            sig = [xxhash.xxh3_128_digest(a.tobytes()) if len(a) else None for a in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(a) for a in sets], pa.int64()), pa.array(sig, pa.binary()),
                 _lists([a[:prefix_length(len(a), percent)] if len(a) else a for a in sets])],
                names=["doc_id", "n", "sig", "prefix"])
        for i in range(0, SLOTS, CHUNK):  # n = -1: the task's counters from i on
            if total[i:i + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([-1]), pa.array([None], pa.binary()), _lists([total[i:i + CHUNK]])],
                                                 names=["doc_id", "n", "sig", "prefix"])
    return run


def _run_keys(tokens: np.ndarray, width: int) -> np.ndarray:
    key = np.full(max(0, len(tokens) - width + 1), width, np.uint64)
    for i in range(width):
        key = (key + tokens[i:i + len(key)]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(28)
    return key.view(np.int64)


def _levels(rows: DataFrame) -> np.ndarray:
    """How frequent each counter's tokens are.  A counter has the mean of all from rare tokens; level 0 is up to RARE
    (and up to what chance gives) above it, and each doubling is one level more."""
    counts = rows.filter("n = -1").select("doc_id", F.posexplode("prefix").alias("at", "n")).groupBy(
        (F.col("doc_id") + F.col("at")).cast("int").alias("slot")).agg(F.sum("n").alias("n"))
    mean = (rows.filter("n = -1").agg(F.sum(F.aggregate("prefix", F.lit(0).cast("long"), lambda t, x: t + x))).first()[0] or 0) / SLOTS
    above = F.col("n") - mean
    often = counts.filter(above > max(RARE, 4 * mean ** 0.5)).select(
        "slot", (F.floor(F.log2(above / RARE)) + 1).cast("byte").alias("level")).toPandas()
    out = np.zeros(SLOTS, np.uint8)
    out[often["slot"].to_numpy(np.int64)] = often["level"].to_numpy(np.uint8)
    return out


def rarest_first(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return tokens[np.argsort(levels[tokens & (len(levels) - 1)], kind="stable")]


def _prefixes(percent: int, shingle: int, levels):
    def run(batches):
        s = Shingler(shingle)
        for b in _text_batches(batches):
            sets = [s.tokens(t) for t in b.column("text").to_pylist()]
            keys = [rarest_first(a, levels.value)[:prefix_length(len(a), percent)] if len(a) else a for a in sets]
            size = [len(k) for k in keys]
            rep = lambda v: pa.array(np.repeat(np.array(v, np.int64), size), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else [], pa.int64()), rep(b.column("doc_id").to_pylist()), rep([len(a) for a in sets])],
                names=["key", "cid", "n"])
    return run


def _runs(percent: int, shingle: int, levels):
    def run(batches):
        s = Shingler(shingle)
        for b in _text_batches(batches):
            sets = [s.tokens(t) for t in b.column("text").to_pylist()]
            keys = []
            for a in sets:
                a = rarest_first(a, levels.value)[:run_length(len(a), K, percent)].view(np.uint64)
                keys.append(np.concatenate([_run_keys(a, w) for w in ((K, K - 1) if len(a) <= SHORT else (K,))]))
            size = [len(k) for k in keys]
            rep = lambda v: pa.array(np.repeat(np.array(v, np.int64), size), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else [], pa.int64()), rep(b.column("doc_id").to_pylist()), rep([len(a) for a in sets])],
                names=["key", "cid", "n"])
    return run


def _with_sets(shingle: int):
    def run(batches):
        s = Shingler(shingle)
        for b in _text_batches(batches):
            sets = [s.tokens(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ys"), _lists(sets)], names=["doc_id", "ys", "tokens"])
    return run


def _of_ids(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """docs joined with a table keyed by doc_id, broadcast only if it has few rows."""
    return docs.join(F.broadcast(ids) if rows <= BROADCAST_IDS else ids, "doc_id")


def verified(docs: DataFrame, pairs: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """The pairs (x, y) of doc_ids whose whole sets are linked, as edges (a, b).  Sets are made from the texts
    again and sent to y's place, so that one shuffle carries one set a pair."""
    rows = pairs.count()
    partners = pairs.groupBy(F.col("x").alias("doc_id")).agg(F.collect_set("y").alias("ys"))  # a text is read once
    mine = _of_ids(docs, partners, rows).select("doc_id", "ys", "text").mapInArrow(
        _with_sets(shingle), "doc_id long, ys array<long>, tokens array<long>").select(
        F.col("doc_id").alias("x"), F.explode("ys").alias("y"), "tokens")
    hubs = pairs.select(F.col("y").alias("doc_id")).distinct()
    theirs = _of_ids(docs, hubs, rows).select("doc_id", F.array().cast("array<long>").alias("ys"), "text").mapInArrow(
        _with_sets(shingle), "doc_id long, ys array<long>, tokens array<long>").select(
        F.col("doc_id").alias("y"), F.col("tokens").alias("others"))
    both = F.size(F.array_intersect("tokens", "others"))
    linked = (100 + percent) * both >= percent * (F.size("tokens") + F.size("others"))
    return scratch.save(mine.join(theirs, "y").filter(linked).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())


def _spanning(percent: int):
    def spanning(rows: pd.DataFrame) -> pd.DataFrame:
        """Of all links between a block pair's components, as many as join them: fewer than members."""
        left = (rows["side"].to_numpy() & 1) > 0
        right = (rows["side"].to_numpy() & 2) > 0
        n = rows["tokens"].map(len).to_numpy(np.int64)
        tokens = np.concatenate([np.asarray(t, np.int64) for t in rows["tokens"]])
        who = np.repeat(np.arange(len(n)), n)
        _, at, seen = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = seen[at] > 1
        who, column = who[shared], (np.cumsum(seen > 1) - 1)[at[shared]]
        by = np.argsort(column, kind="stable")
        who, column = who[by], column[by]
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        common = np.zeros((len(a), len(b)), np.float32)
        width = int(column[-1]) + 1 if len(column) else 0
        for lo in range(0, width, 4096):  # shared tokens in slices, so that the matrices stay small
            some = slice(*np.searchsorted(column, (lo, lo + 4096)))
            m = np.zeros((len(n), min(4096, width - lo)), np.float32)
            m[who[some], column[some] - lo] = 1
            common += m[a] @ m[b].T
        comp, cid = rows["component"].to_numpy(np.int64), rows["cid"].to_numpy(np.int64)
        ok = (comp[a][:, None] != comp[b][None, :]) & ((100 + percent) * common.astype(np.float64) >= percent * (n[a][:, None] + n[b][None, :]))
        root = {c: c for c in set(comp.tolist())}
        out = []
        for i, j in zip(*np.nonzero(ok)):
            x, y = comp[a[i]], comp[b[j]]
            while root[x] != x:
                x = root[x] = root[root[x]]
            while root[y] != y:
                y = root[y] = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((cid[a[i]], cid[b[j]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return spanning


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Every row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).
    The prefixes need 80 percent or more."""
    if percent < 80:
        raise ValueError("a similarity of 0.8 or more is needed")
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.save(docs.mapInArrow(_signed(percent, shingle), "doc_id long, n long, sig binary, prefix array<long>"))
    classes = scratch.save(rows.filter("n > 0").groupBy("sig").agg(
        F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    reps = classes.filter("cid is not null")

    # Single prefix tokens.
    post = reps.select("cid", "n", "copies", F.explode("prefix").alias("key"))
    held = scratch.save(post.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    shared = scratch.save(post.join(held, "key"))
    rare = shared.filter(F.col("m") <= RARE).select(F.lit(1).alias("kind"), "key", "cid", "n", "copies")
    frequent = scratch.save(shared.filter(F.col("m") > RARE).groupBy("cid").agg(F.count("*").alias("f"), F.first("copies").alias("copies")))
    # The classes with frequent prefix tokens again, rarest tokens first.
    texts = _of_ids(docs, frequent.select(F.col("cid").alias("doc_id")), frequent.count()).select("doc_id", "text")
    levels = docs.sparkSession.sparkContext.broadcast(_levels(rows))
    post2 = scratch.save(texts.mapInArrow(_prefixes(percent, shingle, levels), "key long, cid long, n long"))
    held2 = scratch.save(post2.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    shared2 = scratch.save(post2.join(held2, "key").distinct().join(frequent.select("cid", "copies"), "cid"))
    again = shared2.filter(F.col("m") <= RARE).select(F.lit(3).alias("kind"), "key", "cid", "n", "copies")
    deep = scratch.save(shared2.filter(F.col("m") > RARE).groupBy("cid").agg(F.count("*").alias("f"), F.first("copies").alias("copies")))
    # Runs of K tokens for those that still have some.
    texts = _of_ids(docs, deep.select(F.col("cid").alias("doc_id")), deep.count()).select("doc_id", "text")
    runs = scratch.save(texts.mapInArrow(_runs(percent, shingle, levels), "key long, cid long, n long"))
    held3 = runs.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    run_rows = runs.join(held3, "key").join(deep.select("cid", "copies"), "cid").select(F.lit(2).alias("kind"), "key", "cid", "n", "copies")
    buckets = scratch.save(rare.unionByName(again).unionByName(run_rows))
    scratch.drop(shared, held, post2, held2, shared2, runs)

    # Round 1: members against hubs; of a class's hubs, the two that it meets in most buckets.
    hubs = scratch.save(buckets.groupBy("kind", "key").agg(
        F.max(F.struct("copies", (-F.col("cid")).alias("neg"), "n")).alias("h")).select(
        "kind", "key", (-F.col("h.neg")).alias("hub"), F.col("h.n").alias("hub_n")))
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    met = buckets.join(hubs, ["kind", "key"]).filter((F.col("cid") != F.col("hub")) & fits).groupBy("cid", "hub").agg(F.count("*").alias("c"))
    nth = F.row_number().over(Window.partitionBy("cid").orderBy(F.col("c").desc(), "hub"))
    pairs = scratch.save(met.withColumn("nth", nth).filter("nth <= 2").select(F.col("cid").alias("x"), F.col("hub").alias("y")))
    links = verified(docs, pairs, percent, shingle, scratch)
    comp = scratch.save(components(links, scratch))

    # Round 2: buckets with several components left.
    known = comp.select(F.col("node").alias("cid"), "component")
    marked = buckets.join(known, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    marked = scratch.save(marked.drop("copies"))
    mixed = scratch.save(marked.groupBy("kind", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                         .filter("lo != hi").select("kind", "key"))
    open_ = scratch.save(marked.join(mixed, ["kind", "key"]))
    scratch.drop(buckets, marked, mixed, hubs)

    often = frequent.select(F.lit(1).alias("kind"), "cid", "f").unionByName(deep.select(F.lit(3).alias("kind"), "cid", "f"))
    single = open_.filter("kind != 2").join(often, ["kind", "cid"], "left").fillna(0, ["f"])
    x = single.select("kind", "key", *[F.col(c).alias(f"{c}_x") for c in ("cid", "n", "component", "f")])
    y = single.select("kind", "key", *[F.col(c).alias(f"{c}_y") for c in ("cid", "n", "component", "f")])
    # two classes that both have frequent prefix tokens are in the next index
    across = x.join(y, ["kind", "key"]).filter((F.col("cid_x") < F.col("cid_y")) & (F.col("component_x") != F.col("component_y"))
                                               & ((F.col("f_x") == 0) | (F.col("f_y") == 0))
                                               & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")))
    # prefixes that share c tokens, all of them rare, leave room for c + rest in common
    rest = lambda n: F.col(n) - (F.col(n) - F.floor((percent * F.col(n) + 99) / 100) + 1)
    enough = (F.col("c") + F.greatest(rest("n_x"), rest("n_y"))
              >= F.ceil(percent * (F.col("n_x") + F.col("n_y")) / (100 + percent)))
    by_single = across.groupBy("cid_x", "cid_y", "n_x", "n_y").agg(F.count("*").alias("c")).filter(enough) \
        .select(F.col("cid_x").alias("x"), F.col("cid_y").alias("y"))

    runs_left = open_.filter("kind = 2")
    first = runs_left.groupBy("key").agg(F.min("cid").alias("b"))
    # each class goes by the smallest class it meets; buckets then connect these few names, not all members
    near = scratch.save(runs_left.join(first, "key").groupBy("cid").agg(F.min("b").alias("m")))
    named = scratch.save(runs_left.join(near, "cid").select("key", "m").distinct())
    tops = named.groupBy("key").agg(F.min("m").alias("b"))
    joined = named.join(tops, "key").select(F.col("m").alias("a"), "b").unionByName(near.select(F.col("cid").alias("a"), F.col("m").alias("b")))
    family = components(joined.filter("a != b").distinct(), scratch)
    family = scratch.save(family)
    sizes = family.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = family.join(sizes, "component").select(F.col("node").alias("cid"), F.col("component").alias("family"), "blocks") \
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    member = member.withColumn("other", other).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    side = F.when(F.col("bi") == F.col("bj"), 3).when(F.col("block") == F.col("bi"), 1).otherwise(2)
    member = member.select("family", "bi", "bj", side.alias("side"), "cid").join(known, "cid", "left") \
        .withColumn("component", F.coalesce("component", "cid"))
    sets = _of_ids(docs, family.select(F.col("node").alias("doc_id")), family.count()).select(
        "doc_id", F.array().cast("array<long>").alias("ys"), "text").mapInArrow(
        _with_sets(shingle), "doc_id long, ys array<long>, tokens array<long>").select(F.col("doc_id").alias("cid"), "tokens")
    by_run = scratch.save(member.join(sets, "cid").groupBy("family", "bi", "bj").applyInPandas(_spanning(percent), "a long, b long"))

    more = scratch.save(by_single)
    links = links.unionByName(verified(docs, more, percent, shingle, scratch)).unionByName(by_run)
    comp = scratch.save(components(links, scratch)).select(F.col("node").alias("cid"), "component")
    scratch.drop(open_)

    out = rows.filter("n >= 0").select("doc_id", "n", "sig").join(classes.select("sig", "cid"), "sig", "left").join(comp, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "cid", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """docs, all columns: of each component the document with the smallest doc_id (a null one only if there is
    no other), and all without words.  Rows are joined by a hash of doc_id and text, so that null and clashing
    ids neither hide copies nor drop other texts; of rows repeating both, one stays."""
    scratch = Scratch(docs.sparkSession, "keep")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.withColumn("llm_row", F.shiftrightunsigned(F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text), 1))
    found = jaccard_components(rows.select(F.col("llm_row").alias("doc_id"), "text"), percent, shingle).distinct()
    ids = rows.select(F.col("llm_row").alias("row"), doc_id.isNull().alias("none"), doc_id.alias("id")).distinct()
    first = F.min(F.struct("none", "id", "row"))["row"].alias("llm_row")
    stay = found.filter("n_shingles > 0").withColumnRenamed("doc_id", "row").join(ids, "row").groupBy("component_id").agg(first)
    stay = scratch.save(stay.select("llm_row", F.lit(True).alias("words")).unionByName(
        found.filter("n_shingles = 0").select(F.col("doc_id").alias("llm_row"), F.lit(False).alias("words"))))
    kept = rows.join(stay.filter("words"), "llm_row", "left_semi").dropDuplicates(["llm_row"])
    return kept.unionByName(rows.join(stay.filter("not words"), "llm_row", "left_semi")).select(*docs.columns)
