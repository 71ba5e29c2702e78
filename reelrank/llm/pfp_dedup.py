"""Removal of repeated 200-byte strings by prefix-free parsing.

Texts are parsed, as UTF-8 bytes, at *triggers* chosen by a rolling hash: for
every window of ``length`` bytes the position of the smallest hash of
``GRAM`` bytes among its first ``m``.  The choice depends on the window's bytes
alone, so equal windows have their trigger at the same place.  Windows that
share a trigger are neighbours; with the bytes they cover they form a
*phrase*, and the phrases of a text overlap in length - 1 bytes or more, as a
prefix-free parse asks for.  Instead of n windows, some 2 n / m phrases are
shuffled.

A window is a suffix of its phrase's *head* (the bytes before the trigger)
followed by what the parse goes on with (the *tail*: the bytes from the trigger).
So the corpus order of windows combines two smaller orders, of heads and of
tails, and two windows are equal when, o bytes before their triggers, the heads
agree on o bytes and the tails on the other length - o:

1. parse: triggers grouped by the bytes after them (the context that every
   window of the phrase contains); contexts that occur once are dropped;
2. dictionary: the remaining phrases, distinct ones with their counts.  All
   windows of a phrase that occurs twice are repeated;
3. order: distinct phrases whose context others share, where at least one
   occurs once, are sorted by tail (the parse's suffixes) and, read backwards
   from the trigger, by head (the dictionary's suffixes), over range partitions
   of the bytes.  Neighbours with common prefixes R of tails and L of heads share the
   windows o = length - R to L.  The largest R and L of a phrase bound what it can
   share with any other;
4. offsets within those bounds that no neighbour settled (one phrase shares the head,
   another one the tail) are looked up window by window, in their contexts only.

Contexts, phrases and the windows of step 4 are compared by hashes (64 bits,
128 for context and phrase together), step 3 by bytes.

A context or phrase with a third of all rows is counted by partial aggregation
and never gathered; a hot context spans as many range partitions as its
phrases need.  Only the first and last phrase of every range partition reach the
driver, which compares those on either side of a border.  Texts are joined
with lists of places by shuffle, at every size.

Defined cases: null is empty; texts under ``length`` bytes have no window;
overlapping repeats count, within one text too; rows that are equal in doc_id
and text repeat each other wholly.  A row is known by a 64-bit hash of doc_id
and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.llm.store import Scratch, text_or_empty

LENGTH = 200
GRAM = 8

_BASE = np.uint64(0x9E6C63D0876A9A47)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = np.random.default_rng(9).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


OPEN = "key long, row long, place long, alone boolean, head binary, tail binary"
FACTS = ("row long, place long, key long, alone boolean, ahead int, most_tail int, most_head int, sure array<struct<lo:int,hi:int>>, "
         "part int, last boolean, head binary, tail binary")


class Powers:
    """Powers of the hash base and its inverse, as far as the longest text needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 15)
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))))
                                  for b in (_BASE, _INVERSE))


class Parsed:
    """Hashes of substrings of one text, and its phrases."""

    def __init__(self, data: bytes, powers: Powers):
        self.x = np.frombuffer(data, np.uint8)
        powers.reach(len(data) + 1)
        self.down = powers.down
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[self.x] * powers.up[:len(data)], dtype=np.uint64)))

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of data[a:b], as int64."""
        h = (self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def phrases(self, length: int):
        """(trigger, first window, last window) of every phrase, for a text of ``length`` bytes or more."""
        m = trigger_span(length)
        n = len(self.x) - GRAM + 1
        gram = np.empty(n, np.uint64)
        for k in range(min(GRAM, n)):
            part = self.x[k:k + (n - k + GRAM - 1) // GRAM * GRAM].tobytes()
            gram[k::GRAM] = np.frombuffer(part[:len(gram[k::GRAM]) * GRAM], "<u8")
        gram *= np.uint64(0x9FB21C651E98DF25)
        gram ^= gram >> np.uint64(32)
        gram *= np.uint64(0xD6E8FEB86659FD93)
        least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)  # ties go to the first place
        span = 1
        while span < m:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        at = (least[:len(self.x) - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:] - 1, len(at) - 1)
        return at[first], first, last


def trigger_span(length: int) -> int:
    """m: the largest power of two that leaves every window a context of a third of its bytes."""
    return 1 << int(np.log2(2 * length / 3))


def _row_id():
    return F.xxhash64(F.col("doc_id").cast("string"), text_or_empty()).alias("row")


def _contexts(length: int):
    after = length - trigger_span(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                keys = [np.empty(0, np.int64)]
                for text in batch.slice(i, 500).column("text").to_pylist():
                    data = text.encode("utf-8", "surrogatepass")
                    if len(data) >= length:
                        p = Parsed(data, powers)
                        t, _, _ = p.phrases(length)
                        keys.append(p.hashes(t, t + after))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])
    return run


def _phrases(length: int):
    after = length - trigger_span(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                out = [[np.empty(0, np.int64)] for _ in range(4)]
                for row, text in zip(some.column("row").to_pylist(), some.column("text").to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    if len(data) >= length:
                        p = Parsed(data, powers)
                        t, a, b = p.phrases(length)
                        # where the trigger lies in the phrase is part of what makes phrases equal
                        whole = p.hashes(a, b + length) ^ ((t - a) * np.int64(0x2545F4914F6CDD1D))
                        for o, v in zip(out, (p.hashes(t, t + after), whole, np.full(len(t), row, np.int64), a << 16 | (b - a + 1))):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["key", "phrase", "row", "place"])
    return run


def _open_phrases(length: int):
    """The asked phrases with their bytes: ``head`` backwards from the trigger, ``tail`` from the trigger on."""
    after = length - trigger_span(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                out = [[] for _ in range(6)]
                for row, text, places, alone in zip(*(some.column(c).to_pylist() for c in ("row", "text", "places", "alone"))):
                    data = text.encode("utf-8", "surrogatepass")
                    p = Parsed(data, powers)
                    place = np.array(places, np.int64)
                    a = place >> 16
                    b = a + (place & 0xFFFF) - 1
                    trigger, first, _ = p.phrases(length)
                    t = trigger[np.searchsorted(first, a, side="right") - 1]
                    out[0].extend(p.hashes(t, t + after).tolist())
                    out[1].extend([row] * len(places))
                    out[2].extend(places)
                    out[3].extend(alone)
                    for x, y, z in zip(a.tolist(), t.tolist(), (b + length).tolist()):
                        out[4].append(data[x:y][::-1])
                        out[5].append(data[y:z])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)],
                                                 names=["key", "row", "place", "alone", "head", "tail"])
    return run


def _common(strings: list[bytes], width: int) -> np.ndarray:
    """Length of the common prefix of every string (of ``width`` bytes at most) and the next one."""
    size = np.array([len(v) for v in strings], np.int64)
    grid = np.array(strings, f"S{max(width, 1)}").view(np.uint8).reshape(len(strings), -1)
    differ = np.concatenate((grid[1:] != grid[:-1], np.ones((len(strings) - 1, 1), bool)), axis=1)
    return np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))


def _neighbours(length: int):
    """Of sorted phrases: what each shares with the one before and the one after it in its partition.

    One row a phrase (``sure``: offsets before the trigger at which a neighbour has the same window), and
    one for the first and the last phrase of the partition with their bytes (``part`` is set).
    """
    schema = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("key", pa.int64()), ("alone", pa.bool_()), ("ahead", pa.int32()),
                        ("most_tail", pa.int32()), ("most_head", pa.int32()),
                        ("sure", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                        ("part", pa.int32()), ("last", pa.bool_()), ("head", pa.binary()), ("tail", pa.binary())])
    columns = ("row", "place", "key", "alone", "head", "tail")

    def facts(rows: list[tuple], before: tuple[int, int], closing: bool):
        """Of all rows, or of all but the last, whose next one is not known yet; and what the last shares with the one before."""
        row, place, key, alone, head, tail = zip(*rows)
        same = np.array(key[1:], np.int64) == np.array(key[:-1], np.int64)
        tails, heads = (np.where(same, _common(list(v), length), 0).tolist() for v in (tail, head))
        tails, heads = [before[0], *tails], [before[1], *heads]
        carry = tails[-1], heads[-1]
        n = len(rows) if closing else len(rows) - 1
        tails.append(0), heads.append(0)
        sure = [[{"lo": length - r, "hi": h} for r, h in ((tails[i], heads[i]), (tails[i + 1], heads[i + 1])) if length - r <= h]
                for i in range(n)]
        values = [row[:n], place[:n], key[:n], alone[:n], [len(v) for v in head[:n]],
                  [max(tails[i], tails[i + 1]) for i in range(n)], [max(heads[i], heads[i + 1]) for i in range(n)], sure, *[[None] * n] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(values, schema)], schema=schema), carry

    def edge(r: tuple, last: bool):
        part = TaskContext.get().partitionId()
        values = [r[0], r[1], r[2], None, None, None, None, None, part, last, r[4], r[5]]
        return pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(values, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, (0, 0)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                rows = list(zip(*(batch.slice(i, 2000).column(c).to_pylist() for c in columns)))
                if held is None:
                    yield edge(rows[0], False)
                else:
                    rows.insert(0, held)
                out, before = facts(rows, before, closing=False)
                held = rows[-1]
                yield out
        if held is not None:
            yield facts([held], before, closing=True)[0]
            yield edge(held, True)
    return run


def _ordered(scratch: Scratch, phrases: DataFrame, by: list[str], length: int) -> DataFrame:
    """What neighbours share when phrases are sorted by ``by``, over the borders of partitions as well."""
    got = scratch.save(phrases.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_neighbours(length), FACTS))
    edges = got.filter("part is not null").select("part", "last", "row", "place", "key", "head", "tail").orderBy("part", "last").collect()
    across = []
    for x, y in zip(edges[1::2], edges[2::2]):  # the last phrase of a partition and the first one of the next
        if x.key == y.key:
            r, h = (int(_common([bytes(x[c]), bytes(y[c])], length)[0]) for c in ("tail", "head"))
            sure = [(length - r, h)] if length - r <= h else []
            across += [(v.row, v.place, None, None, None, r, h, sure, None, None, None, None) for v in (x, y)]
    facts = got.filter("part is null").unionByName(phrases.sparkSession.createDataFrame(across, FACTS))
    return facts.drop("part", "last", "head", "tail")


def _single_windows(length: int):
    """The windows ``lo`` to ``hi`` bytes before the trigger of every phrase, by hash; ``asked`` where they are in ``rest``."""
    names = ["core", "row", "start", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                out = [[np.empty(0, np.int64)] for _ in range(3)]
                asked = [np.empty(0, bool)]
                for row, place, head, tail, lo, hi, rest in zip(*(some.column(c).to_pylist()
                                                                  for c in ("row", "place", "head", "tail", "lo", "hi", "rest"))):
                    p = Parsed(head[::-1] + tail, powers)
                    o = np.arange(lo, hi + 1)
                    at = len(head) - o
                    core = p.hashes(at, at + length).view(np.uint64) ^ (o.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                    for v, x in zip(out, (core.view(np.int64), np.full(len(o), row, np.int64), (place >> 16) + at)):
                        v.append(x)
                    asked.append(np.isin(o, np.array(rest or [], np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(o)) for o in out), pa.array(np.concatenate(asked))], names=names)
    return run


def union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges [start, end) as maximal runs, ascending."""
    if not len(starts):
        return []
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return list(zip(starts[new].tolist(), np.append(ends[:-1][new[1:]], ends[-1]).tolist()))


def _joined(df: DataFrame, by_row: DataFrame, how: str) -> DataFrame:
    """df with a table keyed by row that holds lists of places; the same plan at every size."""
    return df.join(by_row.hint("merge"), "row", how)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, places): of every row with repeats the ranges to remove, packed start << 24 | bytes."""
    scratch = Scratch(docs.sparkSession, "pfp")
    texts = docs.select(_row_id(), text_or_empty().alias("text")).filter(F.octet_length("text") >= length)
    # 1. contexts that occur more than once
    contexts = texts.select("text").mapInArrow(_contexts(length), "key long").groupBy("key").agg(F.count("*").alias("n")) \
        .filter("n > 1").select("key")
    contexts = scratch.save(contexts)
    # 2. their phrases
    phrases = texts.mapInArrow(_phrases(length), "key long, phrase long, row long, place long")
    phrases = scratch.save(phrases.join(contexts, "key", "left_semi"))
    scratch.drop(contexts)
    entries = scratch.save(phrases.groupBy("key", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")))
    twice = entries.filter("n > 1").select("key", "phrase")
    size = F.col("place").bitwiseAND(0xFFFF)
    span = (F.shiftright("place", 16) * (1 << 24) + size + (length - 1)).alias("place")
    whole = scratch.save(phrases.join(twice, ["key", "phrase"]).select("row", span))
    scratch.drop(phrases)
    # 3. phrases that occur once in a context that others share, and one copy of those others, in order
    shared = entries.groupBy("key").agg(F.count("*").alias("phrases"), F.min("n").alias("least")).filter("phrases > 1 and least = 1").select("key")
    asked = scratch.save(_by_row(entries.join(shared, "key").select("one.row", "one.place", (F.col("n") == 1).alias("alone"))))
    scratch.drop(entries)
    opened = scratch.save(_joined(texts, asked, "inner").mapInArrow(_open_phrases(length), OPEN))
    scratch.drop(asked)
    facts = _ordered(scratch, opened, ["key", "tail", "head"], length).unionByName(_ordered(scratch, opened, ["key", "head", "tail"], length))
    bounds = facts.groupBy("row", "place").agg(
        F.max("key").alias("key"), F.max("alone").alias("alone"), F.max("ahead").alias("ahead"), (F.lit(length) - F.max("most_tail")).alias("lo"),
        F.max("most_head").alias("hi"), F.array_distinct(F.flatten(F.collect_list("sure"))).alias("sure")).filter("lo <= hi")
    settled = lambda o: F.exists("sure", lambda s: o.between(s["lo"], s["hi"]))
    rest = F.when(F.col("alone"), F.filter(F.sequence("lo", "hi"), lambda o: ~settled(o)))
    bounds = scratch.save(bounds.withColumn("rest", rest))
    trigger = F.shiftright("place", 16) + F.col("ahead")
    near = bounds.filter("alone").select("row", "place", "ahead", F.explode("sure").alias("s")) \
        .select("row", ((trigger - F.col("s.hi")) * (1 << 24) + F.col("s.hi") - F.col("s.lo") + length).alias("place"))
    # 4. offsets that no neighbour settled
    keys = bounds.filter(F.size("rest") > 0).select("key").distinct()
    unsettled = bounds.join(keys, "key", "left_semi").select("row", "place", "lo", "hi", "rest")
    windows = scratch.save(opened.select("row", "place", "head", "tail").join(unsettled, ["row", "place"])
                           .mapInArrow(_single_windows(length), "core long, row long, start long, asked boolean"))
    again = windows.groupBy("core").agg(F.count("*").alias("n"), F.max("asked").alias("any")).filter("n > 1 and any")
    parts = windows.filter("asked").join(again.select("core"), "core", "left_semi").select("row", (F.col("start") * (1 << 24) + length).alias("place"))
    scratch.drop(opened)
    places = scratch.save(whole.unionByName(near).unionByName(parts).groupBy("row").agg(F.collect_list("place").alias("places")))
    scratch.drop(bounds, windows, whole)
    return places


def _by_row(ask: DataFrame) -> DataFrame:
    """ask (row, place, alone) as lists by row."""
    by_row = ask.groupBy("row").agg(F.collect_list(F.struct("place", "alone")).alias("l"))
    return by_row.select("row", F.col("l.place").alias("places"), F.col("l.alone").alias("alone"))


def _unpack(places) -> list[tuple[int, int]]:
    p = np.array(places if places is not None else [], np.int64)
    return union(p >> 24, (p >> 24) + (p & 0xFFFFFF))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            some = batch.slice(i, 500)
            size, spans, kept = [], [], []
            for text, places in zip(some.column("text").to_pylist(), some.column("places").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                runs = _unpack(places)
                size.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(e for r in runs for e in r), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(v, k) for v, k in zip((size, spans, kept), kinds[1:]))],
                                             names=["doc_id", "n_bytes", "spans", "kept"])


CUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row: doc_id, n_bytes, spans (byte ranges removed, maximal runs) and the kept bytes."""
    places = repeated_spans(docs, length)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_id(), text_or_empty().alias("text"))
    return _joined(texts, places, "left").select("doc_id", "text", "places").mapInArrow(_cut, CUT)


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(removed bytes, runs, SHA-256 of what is kept) of every text, by counting all windows; for tests."""
    from collections import Counter

    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out
