"""Token-id files with Elias-Fano document boundaries.

The file format is a Parquet table of blocks, in ascending doc_id order
(``shard``, then ``block``).  A block concatenates the ids of whole documents
in little-endian uint16 (uint32 for vocabularies over 65,536) and keeps

* ``ends``: the documents' end positions in the block, Elias-Fano coded: the
  low bits of every value packed, the high bits in unary, and every
  ``STEP``-th one's place as a select structure.  ``ef_select`` answers one
  offset without decoding the rest; there is no 64-bit table;
* ``ids_of``: the documents' ids less the first one, coded the same way;
* ``before``: ids of the shard ahead of the block.

A shard is one range partition of doc_id; its start is the running total of
the shards before it (one row a shard).  Texts are encoded by the tokenizers
library.  Its pre-tokenizer never joins text across white space, so a worker
encodes chunks between ASCII white space (A-Z lowered if the tokenizer does so)
and keeps those it has met lately.  Chunks of plain words and marks go to the
library's model pre-token by pre-token, if the tokenizer's steps before it are
those of ``KNOWN``; all others, and other tokenizers, through the whole library.

Defined cases: null text is empty and holds the end id alone; null doc_ids
come first; rows repeating a doc_id stand next to each other; an empty table
gives an empty file.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelrank.llm.store import text_or_empty

STEP = 64              # ones between two select samples
BLOCK_IDS = 1 << 20    # a block ends at the first document that fills it
CACHE = 300_000        # chunks kept in each of two generations
TEXTS = 128            # texts held as Python strings at once
END_ID = 2

BLOCKS = ("shard int, block int, before long, n_docs int, n_ids long, wide boolean, n_null int, first_id long, "
          "ids binary, ends binary, ids_of binary")


# ---------------------------------------------------------------- Elias-Fano

def ef_encode(values: np.ndarray) -> bytes:
    """Ascending non-negative integers.  Header: count, low width, length of the unary part."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    top = int(v[-1]) + 1 if n else 1
    low = max(0, int(np.floor(np.log2(top / n)))) if n else 0
    high = (v >> np.uint64(low)).astype(np.int64)
    ones = high + np.arange(n)
    unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    unary[ones] = 1
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, low, len(unary)], "<u8").tobytes()
    return (head + ones[::STEP].astype("<u4").tobytes() + np.packbits(unary, bitorder="little").tobytes()
            + np.packbits(bits.ravel(), bitorder="little").tobytes())


def _parts(data: bytes):
    n, low, n_unary = (int(x) for x in np.frombuffer(data, "<u8", 3))
    a = 24 + 4 * (-(-n // STEP))
    b = a + -(-n_unary // 8)
    return n, low, n_unary, np.frombuffer(data[24:a], "<u4"), np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b:], np.uint8)


def ef_decode(data: bytes) -> np.ndarray:
    n, low, n_unary, _, unary, rest = _parts(data)
    ones = np.flatnonzero(np.unpackbits(unary, count=n_unary, bitorder="little"))
    bits = np.unpackbits(rest, count=n * low, bitorder="little").reshape(n, low).astype(np.int64)
    return ((ones - np.arange(n)) << low) + (bits << np.arange(low)).sum(axis=1)


def ef_select(data: bytes, i: int) -> int:
    """The i-th value: from the select sample before it, by counting ones byte by byte."""
    n, low, n_unary, samples, unary, rest = _parts(data)
    if not 0 <= i < n:
        raise IndexError(i)
    at, left = int(samples[i // STEP]), i % STEP
    byte, here = at // 8, int(unary[at // 8]) >> (at % 8) << (at % 8)
    while left >= here.bit_count():
        left -= here.bit_count()
        byte += 1
        here = int(unary[byte])
    for _ in range(left):
        here &= here - 1
    one = byte * 8 + (here & -here).bit_length() - 1
    value = (one - i) << low
    for b in range(low):
        p = i * low + b
        value |= (int(rest[p // 8]) >> (p % 8) & 1) << b
    return value


# ---------------------------------------------------------------- encoding

#: Of a tokenizer with this normalizer and pre-tokenizer, ``RUNS`` are the pre-tokens of a chunk that they cover: letters of ASCII and
#: Latin-1, single digits, and ASCII marks but the apostrophe (it may begin "'s" and its like) and "<" (it begins added tokens).
KNOWN = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:;=>?@\[-`{-~]+")


def _byte_letters() -> dict[int, int]:
    """The letter of every byte in a byte-level vocabulary: printing ones stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class _Young(dict):
    """Chunks met lately; one that isn't there is learnt when it is looked up."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.learn(chunk)
        return ids


class Encoder:
    """Ids of texts, chunk by chunk.  Chunks already encoded are kept in two generations of ``CACHE``
    each: when the young one is full it becomes the old one, and chunks met again move back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        self.model = t.model
        self.wide = t.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.folds = t.normalizer is not None and t.normalizer.normalize_str("A") == "a"
        self.special = [a.content.lower().encode() for a in t.get_added_tokens_decoder().values()]
        steps = tuple(x and json.loads(x.__getstate__()) for x in (t.normalizer, t.pre_tokenizer))
        self.by_runs = steps == KNOWN and all(b"<" in s for s in self.special)
        self.young, self.old = _Young(self._learn), {}

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'I' if self.wide else 'H'}", *ids)

    def _learn(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is not None:
            return ids
        text = chunk.decode("utf-8", "surrogatepass")
        runs = RUNS.findall(text) if self.by_runs else []
        if sum(map(len, runs)) != len(text):
            return self._packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        if len(runs) > 1:
            return b"".join([self.young[run.lower().encode()] for run in runs])
        # one pre-token, which normalizing and pre-tokenizing would change in case alone: the library's model does
        run = text.lower()
        return self._packed([t.id for t in self.model.tokenize(
            run if run.isascii() else run.encode().decode("latin-1").translate(BYTE_LETTERS))])

    def _chunks(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass")
        plain = raw.lower()  # A-Z alone
        if not self.folds or any(s in plain for s in self.special):  # special tokens are found by their case
            plain = raw
        return plain.split()  # at ASCII white space

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if len(self.young) > CACHE:
                self.young, self.old = _Young(self._learn), self.young
            yield b"".join(map(self.young.__getitem__, self._chunks(text)))


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One tokenizer and cache a Python worker; its later tasks go on with them."""
    return Encoder(path)


def _blocks(path: str, end_id: int, block_ids: int):
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], encode.kind).tobytes()
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, payload, size, limit = [], [], 0, block_ids * encode.kind.itemsize

        def close() -> pa.RecordBatch:
            nonlocal block, before, ids, payload, size
            ends = np.cumsum([len(p) for p in payload]) // encode.kind.itemsize
            n_null = sum(i is None for i in ids)
            real = np.array([i for i in ids if i is not None], np.int64)
            first = int(real[0]) if len(real) else 0
            row = (shard, block, before, len(ids), int(ends[-1]), encode.wide, n_null, first, b"".join(payload),
                   ef_encode(ends), ef_encode(real - first))
            block, before, ids, payload, size = block + 1, before + row[4], [], [], 0
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=schema)

        kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in BLOCKS.split(", ")])
        for whole in batches:
            for batch in (whole.slice(i, TEXTS) for i in range(0, whole.num_rows, TEXTS)):
                for doc_id, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    data += end
                    ids.append(doc_id)
                    payload.append(data)
                    size += len(data)
                    if size >= limit:
                        yield close()
        if ids:
            yield close()
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every document of ``docs`` (doc_id, text) to ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_blocks(tokenizer, end_id, block_ids), BLOCKS).write.option("compression", "zstd").parquet(path)


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            kind = "<u4" if r["wide"] else "<u2"
            ids = np.frombuffer(r["ids"], kind)
            ends = ef_decode(r["ends"])
            starts = np.concatenate(([0], ends[:-1]))
            doc_ids = [None] * r["n_null"] + (ef_decode(r["ids_of"]) + r["first_id"]).tolist()
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(starts + r["base"] + r["before"], pa.int64()),
                 pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark, path: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    # one row a range partition: bounded by the partitions of the writing job
    return blocks.join(F.broadcast(base), "shard").mapInArrow(
        _documents_of, "doc_id long, start long, n_tokens long, ids_crc32 long")
