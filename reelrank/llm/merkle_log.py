"""Merkle manifest of a dataset, written as a postorder append log.

Every row is a leaf: the SHA-256 (lowercase hex) of its columns, each as ``-`` if null and
else as its UTF-8 byte count, ``:`` and the value.  The leaves of one group ascend by key;
every ``FANOUT`` consecutive nodes (the last run may be shorter, even one node) become the
SHA-256 of their hex digests, level by level, until one node remains: the group's subroot.
The subroots, null group first and then bytewise by group, form the root in the same way.

Aligned builders: leaves ``512 b`` to ``512 b + 511`` of a tree are one builder's, which
appends each leaf and closes each run as soon as it is complete, so its segment of the log
holds nodes in completion order (postorder).  A builder's last node is a leaf of the next
round's builders.  Positions follow from subtree sizes alone (``position``): node i of level
h is complete once ``e = min((i + 1) 8^h, n)`` leaves are there; until then the log holds
``ceil(e / 8^l)`` nodes of every level l up to h and ``floor((e - 1) / 8^l)`` of every
level above.  Proofs read siblings from a segment at these positions; what lies above a
segment is the same for all its leaves and is handed down from round to round.

Scale: one sort by (group, key) of digests (a group's rows spread over many tasks, and a
row's place is its place in its sorted part plus the rows of earlier parts); a builder holds
512 leaves however large a group is; the rounds grow with log512 of the largest group.

Edge cases: a null key sorts first; rows with one key are ordered by their leaf, so equal
rows are leaves of their own; an empty table gives no rows; a null text is ``-`` and an empty
one ``0:``; texts are hashed whole; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelrank.llm.store import Scratch

FANOUT = 8
LEVELS = 3  # levels above its leaves that a builder writes: 512 leaves
BLOCK = FANOUT ** LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_BITS = 33  # of monotonically_increasing_id: row in its part


# ---------------------------------------------------------------- leaves

def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(columns: dict[str, Column]) -> Column:
    """Digest (binary) of a row's columns in their order."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in columns.values()]), 256))


def tree_key(group: Column) -> Column:
    """Groups as strings in the order of the subroots: null first, then bytewise."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


# ---------------------------------------------------------------- shape of a tree

def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def position(h: int, i: int, n: int, top: int) -> int:
    """Place in the log of node ``i`` of level ``h`` in a tree of ``n`` leaves and ``top`` levels above them."""
    e = min((i + 1) * FANOUT ** h, n)
    return (sum(-(-e // FANOUT ** k) for k in range(h + 1)) + sum((e - 1) // FANOUT ** k for k in range(h + 1, top + 1)) - 1)


def digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def append_log(leaves: list[str], top: int) -> list[str]:
    """The nodes over ``leaves`` in completion order; ``top`` levels are closed at the end."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(top + 1)]

    def put(level: int, node: str) -> None:
        log.append(node)
        waiting[level].append(node)
        if level < top and len(waiting[level]) == FANOUT:
            close(level)

    def close(level: int) -> None:
        run, waiting[level] = waiting[level], []
        put(level + 1, digest(run))

    for d in leaves:
        put(0, d)
    for level in range(top):
        if waiting[level]:
            close(level)
    return log


def siblings(log: list[str], i: int, n: int, top: int) -> list[tuple[int, list[str]]]:
    """For each level over leaf ``i``: its node's place in the run and the run's others."""
    out = []
    for h in range(top):
        first, count = i // FANOUT * FANOUT, -(-n // FANOUT ** h)
        run = [log[position(h, j, n, top)] for j in range(first, min(first + FANOUT, count))]
        out.append((i - first, run[:i - first] + run[i - first + 1:]))
        i //= FANOUT
    return out


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and the siblings on its way up lead to."""
    for k, others in path:
        node = digest(others[:k] + [node] + others[k:])
    return node


def pack(path: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(bytes([k, len(others)]) + bytes.fromhex("".join(others)) for k, others in path)


def unpack(data: bytes) -> list[tuple[int, list[str]]]:
    out, at = [], 0
    while at < len(data):
        k, count = data[at], data[at + 1]
        out.append((k, _split(data[at + 2:at + 2 + 32 * count])))
        at += 2 + 32 * count
    return out


def _split(data: bytes) -> list[str]:
    text = data.hex()
    return [text[k:k + 64] for k in range(0, len(text), 64)]


# ---------------------------------------------------------------- building

def ranked(rows: DataFrame, scratch: Scratch, order: list[Column]) -> DataFrame:
    """``rows`` (tree, ...) with idx, the row's place in its tree by ``order``, and n, the tree's rows."""
    cols = rows.columns
    placed = scratch.save(rows.orderBy("tree", *order).withColumn("_mid", F.monotonically_increasing_id()).select(
        *cols, F.shiftright("_mid", _ROW_BITS).alias("_part"), F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1).alias("_pos")))
    pieces = placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_n").over(tree).alias("n"))
    return placed.join(pieces, ["tree", "_part"]).select(*cols, (F.col("_pos") + F.col("_shift")).alias("idx"), "n")


def _segments(nodes: DataFrame, keys: bool) -> DataFrame:
    """One row a builder: tree, block, n (leaves of the tree), leaves, log, top and, with ``keys``, what its leaves carry."""
    schema = "tree string, block long, n long, leaves int, log binary, top binary" + (", doc_id array<long>, changed binary" if keys else "")

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        n = group["n"][0].as_py()
        log = append_log([d.hex() for d in group["digest"].to_pylist()], min(LEVELS, height(n)))
        row = {"tree": group["tree"][0].as_py(), "block": group["block"][0].as_py(), "n": n, "leaves": group.num_rows,
               "log": bytes.fromhex("".join(log)), "top": bytes.fromhex(log[-1])}
        if keys:
            row |= {"doc_id": group["doc_id"].to_pylist(), "changed": b"".join(group["changed"].to_pylist())}
        return pa.Table.from_pylist([row], schema=arrow)

    arrow = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("leaves", pa.int32()), ("log", pa.binary()),
                       ("top", pa.binary())] + ([("doc_id", pa.list_(pa.int64())), ("changed", pa.binary())] if keys else []))
    return nodes.withColumn("block", F.floor(F.col("idx") / BLOCK).cast("long")).groupBy("tree", "block").applyInArrow(build, schema)


def build_log(nodes: DataFrame, scratch: Scratch, keys: bool = False) -> list[DataFrame]:
    """Segments of every round for ``nodes`` (tree, idx, n, digest and, with ``keys``, doc_id, changed).

    A tree's top is in the round in which its n is at most 512."""
    rounds = [scratch.save(_segments(nodes, keys))]
    while rounds[-1].filter(F.col("n") > BLOCK).limit(1).count():
        rounds.append(scratch.save(_segments(rounds[-1].filter(F.col("n") > BLOCK).select(
            "tree", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("digest")), False)))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """tree, top: the digest of every tree's last node."""
    found = [r.filter(F.col("n") <= BLOCK).select("tree", "top") for r in rounds]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- reading

def _handed_down(segments: DataFrame, above: DataFrame) -> DataFrame:
    """Segments with the path from their last node to the root and the tops on it."""
    return segments.withColumn("whole", F.col("n") <= BLOCK).join(above, ["tree", "block", "whole"])


def _inner_paths(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every leaf of a segment: tree, block (the leaf's place), whole, path, tops."""
    for batch in rows:
        for r in batch.to_pylist():
            log, top = _split(r["log"]), min(LEVELS, height(r["n"]))
            count, first = r["leaves"], r["block"] * BLOCK
            yield pa.RecordBatch.from_pydict({
                "tree": [r["tree"]] * count, "block": list(range(first, first + count)), "whole": [False] * count,
                "path": [pack(siblings(log, i, count, top)) + r["path"] for i in range(count)], "tops": [r["tops"]] * count},
                schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("whole", pa.bool_()), ("path", pa.binary()), ("tops", pa.binary())]))


PATHS = "tree string, block long, whole boolean, path binary, tops binary"
PROOFS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
          "log_position long")


def _proofs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for r in batch.to_pylist():
            log, changed, above = _split(r["log"]), _split(r["changed"]), unpack(r["path"])
            subroot, root = _split(r["tops"])
            count, first, top, whole = r["leaves"], r["block"] * BLOCK, min(LEVELS, height(r["n"])), height(r["n"])
            out: dict[str, list] = {name.split()[0]: [] for name in PROOFS.split(", ")}
            for i in range(count):
                path = siblings(log, i, count, top) + above
                folded = fold(changed[i], path)
                values = (r["doc_id"][i], log[position(0, i, count, top)], subroot, root, digest([d for _, others in path for d in others]),
                          folded, folded == root, position(0, first + i, r["n"], whole))
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
                ("verified", pa.bool_()), ("log_position", pa.int64())]))


def log_table(rounds: list[DataFrame]) -> DataFrame:
    """tree, position, level, idx, digest: every node of the log at its place among all nodes of its tree."""
    def places(level: int):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for r in batch.to_pylist():
                    count, log, top = r["leaves"], _split(r["log"]), min(LEVELS, height(r["n"]))
                    # a builder's leaves above the first round are the last nodes of builders below, already in the log
                    nodes = [(h, i) for h in range(1 if level else 0, top + 1) for i in range(-(-count // FANOUT ** h))]
                    n, whole = r["total"], height(r["total"])
                    at = [(h + level, i + (r["block"] * BLOCK) // FANOUT ** h) for h, i in nodes]
                    yield pa.RecordBatch.from_pydict({
                        "tree": [r["tree"]] * len(nodes), "position": [position(h, i, n, whole) for h, i in at], "level": [h for h, _ in at],
                        "idx": [i for _, i in at], "digest": [log[position(h, i, count, top)] for h, i in nodes]},
                        schema=pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())]))
        return run

    sizes = rounds[0].filter(F.col("block") == 0).select("tree", F.col("n").alias("total"))
    parts = [r.select("tree", "block", "n", "leaves", "log").join(sizes, "tree").mapInArrow(
        places(k * LEVELS), "tree string, position long, level int, idx long, digest string") for k, r in enumerate(rounds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Manifest:
    """The logs of a dataset's groups and of their subroots, in the cluster's shared folder."""

    def __init__(self, docs: DataFrame, changed: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS,
                 key: str = "doc_id", group: str = "lang"):
        """``changed``: other values of some columns, whose leaves are folded with the logged siblings instead of the rows' own."""
        self.scratch = Scratch(docs.sparkSession, "merkle")
        own = {c: F.col(c) for c in columns}
        rows = docs.select(tree_key(F.col(group)).alias("tree"), F.col(key).cast("long").alias("doc_id"), leaf(own).alias("digest"),
                           (leaf(own | changed) if changed else leaf(own)).alias("changed"))
        leaves = self.scratch.save(rows)
        self.rounds = build_log(ranked(leaves, self.scratch, [F.col("doc_id").asc_nulls_first(), F.col("digest")]), self.scratch, keys=True)
        subroots = tops(self.rounds).select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("top").alias("digest"))
        self.order = self.scratch.save(ranked(subroots, self.scratch, [F.col("group")]))
        self.root_rounds = build_log(self.order.drop("group"), self.scratch)

    def _paths(self, rounds: list[DataFrame], above: DataFrame) -> DataFrame:
        """``above`` (tree, path, tops of the trees' last nodes), handed down to the segments of the first round."""
        own = lambda r: r.filter(F.col("n") <= BLOCK).join(above, "tree").select(
            "tree", "block", F.lit(True).alias("whole"), "path", F.concat("top", "tops").alias("tops"))
        at = own(rounds[-1])
        for r, below in zip(rounds[:0:-1], rounds[-2::-1], strict=True):
            inner = _handed_down(r, at).select("tree", "block", "n", "leaves", "log", "path", "tops").mapInArrow(_inner_paths, PATHS)
            at = self.scratch.save(inner.unionByName(own(below)))
        return at

    def proofs(self) -> DataFrame:
        """Every row's leaf, subroot, root, digest of its siblings, the root folded from its changed leaf, and its place in the log."""
        spark: SparkSession = self.order.sparkSession
        nothing = spark.createDataFrame([("", b"", b"")], "tree string, path binary, tops binary")
        at = _handed_down(self.root_rounds[0], self._paths(self.root_rounds, nothing))
        paths = at.select("tree", "block", "n", "leaves", "log", "path", "tops").mapInArrow(_inner_paths, PATHS)
        groups = self.scratch.save(self.order.select(F.col("idx").alias("block"), "group").join(paths, "block").select(
            F.col("group").alias("tree"), "path", "tops"))
        rows = _handed_down(self.rounds[0], self._paths(self.rounds, groups))
        return rows.select("block", "n", "leaves", "log", "doc_id", "changed", "path", "tops").mapInArrow(_proofs, PROOFS)


def lower_cased(every: int = 3, key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Tampering for checks: A-Z of ``text`` lower-cased in rows whose key's crc32 ``every`` divides (a null key: never)."""
    hit = F.coalesce(F.crc32(F.col(key).cast("string")) % every == 0, F.lit(False))
    return {text: F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))}
