"""Mixing, sharding, token files and the pipeline."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_paths import SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

import __spark_entry__ as E
import corpus_pipeline
from reelrank.llm import kd_shards, mixing, token_files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- mixing

def fill_by_force(sizes, weights, cap=3):
    clamped = set()
    while True:
        rest = sum(sizes) - sum(cap * sizes[i] for i in clamped)
        w = sum(weights) - sum(weights[i] for i in clamped)
        over = {i for i in range(len(sizes)) if i not in clamped and rest * weights[i] > cap * sizes[i] * w}
        if not over:
            return [cap * sizes[i] if i in clamped else (rest * weights[i] / w) for i in range(len(sizes))]
        clamped |= over


def test_water_filling_matches_brute_force(spark):
    for sizes in ([5, 1000, 7, 3], [0, 10, 10], [1], [0, 0], [1, 1, 1, 100, 3, 50]):
        rows = [(f"s{i}", n, i % 3 + 1) for i, n in enumerate(sizes)]
        got = mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight long"), sum(sizes))
        assert [r.target for r in got.orderBy("source").collect()] == pytest.approx(fill_by_force(sizes, [r[2] for r in rows]))


def test_mixture_repeats_rows(make, empty):
    rows = [(i, "w " * (i % 9), None, "big") for i in range(400)] + [(1000 + i, "a b c", None, "tiny") for i in range(6)]
    rows += [(2000, None, None, None), (2001, "x y", None, None), (2001, "x y", None, None), (None, "q", None, "")]
    docs = make(rows)
    plan = {r.source: r for r in mixing.mixture_plan(docs).collect()}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.words()).alias("n")).collect()}
    for s, p in plan.items():
        assert abs((taken.get(s) or 0) - p.target) <= 8, s
    assert plan["tiny"].target == 3 * 18 and out.groupBy("doc_id", "source").count().agg(F.max("count")).first()[0] <= 6
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixture(docs).collect()))
    assert mixing.mixture(empty).count() == 0


# ---------------------------------------------------------------- sharding

def test_shards_are_balanced_and_slots_gapless(make, empty):
    rows = [(i, "x" * (i * 37 % 900), ["de", "en", None][i % 3], f"s{i % 5}" if i % 2 else "hot") for i in range(1500)]
    rows += [(5000 + i, "copy " * 40) for i in range(700)] + [(1, "x" * 37), (None, None), (None, "")]
    placed = kd_shards.kd_shards(make(rows), n_shards=8).toPandas()
    assert len(placed) == len(rows)
    by = placed.groupby("shard")
    assert by["size"].sum().max() < 1.06 * by["size"].sum().mean() and len(by) == 8
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by)
    small = placed.groupby("text_crc32").filter(lambda g: g["size"].sum() < 1200)
    assert (small.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert placed["size"].sum() == sum(len(r[1] or "") + 1 for r in rows)
    assert kd_shards.kd_shards(empty, n_shards=8).count() == 0
    one = kd_shards.kd_shards(make(rows), target_bytes=10 ** 9)
    assert one.select("shard").distinct().count() == 1


def test_equal_texts_stay_together_unless_too_heavy(make):
    rows = [(i, f"{i} " + "x" * (i * 37 % 900)) for i in range(2000)] + [(3000 + i, "some copy " * 60) for i in range(15)]
    rows += [(4000 + i, "heavy " * 50) for i in range(500)] + [(5000, "long " * 3000)] * 2
    placed = kd_shards.kd_shards(make(rows), n_shards=8).toPandas()
    shard = placed["size"].sum() / 8
    groups = placed.groupby("text_crc32").agg(size=("size", "sum"), shards=("shard", "nunique"))
    assert (groups[groups["size"] <= shard / kd_shards.HEAVY]["shards"] == 1).all()
    assert (groups["size"] > shard / 64).sum() > (groups["shards"] > 1).sum() >= 1
    assert placed.groupby("shard")["size"].sum().max() < 1.1 * shard


def test_plan_of_a_level_does_not_grow(spark):
    nodes = [(0, 4096)]
    units = spark.range(1).selectExpr("id as grp", "id as salt", "1L as bytes", "0D as x0", "0D as x1", "0D as x2", "0D as x3", "0 as tie", "0 as node")
    sizes = []
    while len(nodes) < 4096:
        plan = kd_shards._split(units, kd_shards._node_table(spark, nodes))._jdf.queryExecution().analyzed().toString()
        sizes.append(plan.count("Range ("))
        nodes = kd_shards._halves(nodes)
    assert len(sizes) == 12 and len(set(sizes)) == 1
    assert nodes == [(i, 1) for i in range(4096)]
    assert kd_shards._halves([(0, 5)]) == [(0, 2), (2, 3)]


# ---------------------------------------------------------------- token files

@given(st.lists(st.integers(0, 2 ** 40), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    v = sorted(values)
    data = token_files.ef_encode(np.array(v, np.int64))
    assert token_files.ef_decode(data).tolist() == v
    assert [token_files.ef_select(data, i) for i in range(0, len(v), 7)] == v[::7]


def test_elias_fano_is_near_minimal():
    n, u = 10_000, 10_000 * 500
    v = np.sort(np.random.default_rng(0).integers(0, u, n))
    assert len(token_files.ef_encode(v)) * 8 / n < 2 + np.log2(u / n) + 1


PIECES = ["Plain", "words", "École", "Straße", "ÿ", "don't", "7", "1234", "!?", "...", "(", "'s", "<|endoftext|>", "<", "µ", "ª", "×", "\u212b", "e\u0301", "İ", "ΑΣ", "½", "🙂", "\x1c", "|", "~"]


@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=5).map("".join), max_size=12).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_encoder_by_runs_equals_the_library(text):
    enc = token_files.encoder(TOKENIZER)
    want = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, enc.kind).tobytes()
    assert list(enc([text, text])) == [want, want]


def test_encoder_sends_plain_chunks_to_the_model_alone(tmp_path):
    enc, sent = token_files.Encoder(TOKENIZER), []

    class Library:
        def encode_batch_fast(self, chunks, **kw):
            sent.extend(chunks)
            return enc_library.encode_batch_fast(chunks, **kw)

    enc_library, enc.tokenizer = enc.tokenizer, Library()
    list(enc(["Plain words, École (1234)!", "don't Ωmega"]))
    assert sorted(sent) == ["don't", "Ωmega"]
    # another pre-tokenizer: everything goes through the library
    other = Tokenizer.from_file(TOKENIZER)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    other.save(str(tmp_path / "t.json"))
    assert not token_files.Encoder(str(tmp_path / "t.json")).by_runs


def test_token_files_round_trip(spark, make, empty, tmp_path):
    odd = ["", None, "Don't STOP <|endoftext|> x", "a\x1cb\x0b c　d́ é", "héllo\nwörld\t!!", "x" * 5000, "the " * 20_000, "1234 ½ 🙂🙂", "Ab, ab, w!!! ab?! !, <|ENDOFTEXT|> İx ΑΣ."]
    rows = list(enumerate(odd * 5)) + [(3, "again"), (3, "again"), (-7, "minus"), (None, "null id")]
    path = str(tmp_path / "t")
    token_files.write_token_files(make(rows), path, TOKENIZER, block_ids=500)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, path).select(
        "start", F.coalesce("doc_id", F.lit(-99)), "n_tokens", "ids_crc32").collect())
    enc, want, start = Tokenizer.from_file(TOKENIZER), [], 0
    ids = {i: [] for i, _ in rows}
    for i, t in rows:
        ids[i].append(np.array(enc.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    assert [g[1] for g in got] == sorted(-99 if i is None else i for i, _ in rows)
    for _, i, n, crc in got:
        some = ids[None if i == -99 else i]
        assert any(len(a) == n and zlib.crc32(a.tobytes()) == crc for a in some)
        want.append((start, n))
        start += n
    assert [(s, n) for s, _, n, _ in got] == want
    token_files.write_token_files(empty, path + "0", TOKENIZER)
    assert token_files.read_token_files(spark, path + "0").count() == 0


# ---------------------------------------------------------------- queries and pipeline

def test_queries_return_every_document(spark):
    n = spark.read.parquet(f"{SF01}/documents.parquet").count()
    for k in (2, 3, 4, 5, 7, 8, 9, 10):
        name = next(q for q in E.queries() if q.startswith(f"op{k}_"))
        assert E.queries()[name](spark, SF01).select("doc_id").distinct().count() == n, name


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF01)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "tokens":
            assert docs.columns == before.columns
    assert set(kept["tokens"]) == set(kept["mix"]) and len(kept["tokens"]) == len(kept["mix"])
    assert set(kept["mix"]) <= set(kept["decontaminate"]) < set(kept["near_duplicates"]) < set(kept["toxicity"])
    # the same stages by brute force
    from test_dedup_join import components_by_force

    from reelrank.llm import fm_index

    texts = dict(spark.read.parquet(str(tmp_path / "toxicity")).select("doc_id", "text").collect())
    want = {c if n else i for i, n, c in components_by_force(sorted(texts.items()), 80, 5)}
    assert set(kept["near_duplicates"]) == want
    phrases = {tuple(w[i:i + 10]) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()
               for w in [fm_index.words_of(r.text)] for i in range(max(1, len(w) - 9))}
    clean = {i for i in want if not any(tuple(w[j:j + 10]) in phrases for w in [fm_index.words_of(texts[i])] for j in range(len(w)))}
    assert set(kept["decontaminate"]) == clean
