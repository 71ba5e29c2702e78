"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (``DIM`` of them, drawn from a
generator seeded with the letter).  A letter trigram is bound by permuting:
shift(a, 2) * shift(b, 1) * c, where a run of non-letters counts as one blank.
A document's vector bundles (adds) its trigrams' vectors; a language's
prototype bundles the unit vectors of all its training documents.  Documents
are compared with the prototypes by cosine.

Unit vectors are added as integers (``UNIT`` parts), so that prototypes do not
depend on the order of rows.  Only they, one a language, reach the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0,
and so is every text if nothing was learned; training rows with null lang are
not used; equal cosines go to the smaller language name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024
UNIT = 1 << 20
SEED = 20_240
CACHE = 40_000  # trigram vectors kept by a task


class Bundler:
    """Document vectors; keeps letter and trigram vectors."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self.alpha = np.array([chr(c).isalpha() for c in range(0x110000)])
        self.clear()

    def clear(self):
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, self.dim), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.default_rng(SEED + c).integers(0, 2, self.dim, np.int8) * np.int8(2) - np.int8(1)
        return self.letters[c]

    def row(self, key: int) -> int:
        k = len(self.rows)
        if k == len(self.table):
            self.table = np.concatenate((self.table, np.empty_like(self.table)))
        mask = (1 << 21) - 1
        self.table[k] = np.roll(self.letter(key >> 42), 2) * np.roll(self.letter(key >> 21 & mask), 1) * self.letter(key & mask)
        self.rows[key] = k
        return k

    def vector(self, text: str | None) -> np.ndarray | None:
        """The bundle of the text's trigrams; None without a letter."""
        if not text:
            return None
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        is_letter = self.alpha[c]
        if not is_letter.any():
            return None
        c = np.where(is_letter, c, 32)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first of a run of non-letters stays, as a blank
        keep[0] = is_letter[0]
        c = np.concatenate(([32], c[keep], [32] if is_letter[-1] else []))
        c = c.astype(np.int64)
        keys, counts = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)
        if len(self.rows) + len(keys) > CACHE:
            self.clear()
        known = self.rows.get
        rows = [r if (r := known(k)) is not None else self.row(k) for k in keys.tolist()]
        out = np.zeros(self.dim, np.float32)
        for a in range(0, len(rows), 4096):
            out += counts[a:a + 4096].astype(np.float32) @ self.table[rows[a:a + 4096]].astype(np.float32)
        return out


def _unit(v: np.ndarray) -> np.ndarray | None:
    n = np.linalg.norm(v)
    return v / n if n > 0 else None


def prototypes(train: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Language to unit vector, from rows (text, lang); one row a language reaches the driver."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, sums = Bundler(dim), {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                v = b.vector(text)
                v = None if v is None else _unit(v)
                if v is not None:
                    s = sums.setdefault(lang, np.zeros(dim, np.int64))
                    s += np.rint(v.astype(np.float64) * UNIT).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [s.tolist() for s in sums.values()]})

    part = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")) \
        .filter("text is not null and lang is not null").mapInPandas(bundle, "lang string, v array<long>")
    sums = part.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).select("lang", "v.x").collect()
    out = {r["lang"]: _unit(np.array(r["x"], np.float64)) for r in sorted(rows, key=lambda r: r["lang"])}
    return {k: v for k, v in out.items() if v is not None}


PREDICTED = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, protos: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """Every document: doc_id, lang_pred and the cosine with that language's prototype (0 to 1)."""
    names = list(protos)
    bc = docs.sparkSession.sparkContext.broadcast((names, np.array([protos[k] for k in names]).reshape(len(names), dim)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (names, matrix), b = bc.value, Bundler(dim)
        for batch in batches:
            pred, score = [], []
            for text in batch["text"]:
                v = b.vector(text) if names else None
                v = None if v is None else _unit(v)
                if v is None:
                    pred.append("und")
                    score.append(0.0)
                else:
                    cos = matrix @ v.astype(np.float64)
                    k = int(cos.argmax())
                    pred.append(names[k])
                    score.append(float(min(1.0, max(0.0, cos[k]))))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": pred, "score": score})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PREDICTED)
