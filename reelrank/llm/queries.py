"""One registered query per operator: ``REGISTRY[name](spark, sf_dir) -> DataFrame``.

Each applies its operator with production parameters to the whole table and
derives the digest columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.llm import (binary_codes, crf_toxicity, exact_dedup, fm_index, hard_negatives, hd_language, jaccard_join, kd_shards,
                          merkle_log, mixing, pfp_dedup, sanitise, token_files)
from reelrank.llm.store import documents, table
from reelrank.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op2_mix_water_filling(spark, sf):
    """How many words of every document the mix takes, its source's size and target."""
    docs = documents(spark, sf).select("doc_id", "source", mixing.words().alias("size"))
    taken = mixing.with_repeats(docs, mixing.mixture_plan(documents(spark, sf)))
    return taken.select("doc_id", "size", F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_repeats")).alias("taken"))


@query
def op3_exact_dedup_golomb(spark, sf):
    """Every document with the copy that stays, its group's size and the hash of its normalised text."""
    return exact_dedup.exact_groups(documents(spark, sf))


@query
def op5_kd_tree_shards(spark, sf):
    """All documents in 8 k-d tree shards of near equal bytes."""
    placed = kd_shards.kd_shards(documents(spark, sf), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_token_files_elias_fano(spark, sf):
    """Every text's ids written to token files and read back: place, length and checksum."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_files.write_token_files(documents(spark, sf), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path)


@query
def op10_decontaminate_fm_index(spark, sf):
    """Words of every document that a benchmark window covers, and the items they come from."""
    got = fm_index.removal_spans(documents(spark, sf), table(spark, sf, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                      fm_index.items_sha256(F.col("item_ids")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _remainder(n: int):
    """crc32 of the doc_id as text, modulo n: splits documents into training and held-out ones."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op1_toxicity_crf(spark, sf):
    """Every document's toxicity score from a CRF trained on labels outside the held-out fifth."""
    docs = documents(spark, sf)
    tagger = crf_toxicity.train(docs, table(spark, sf, "labels"), _remainder(5) != 0)
    got = crf_toxicity.score_documents(docs, tagger)
    return got.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))


@query
def op6_language_hd(spark, sf):
    """Every document's language by cosine with prototypes learned outside the held-out third."""
    docs = documents(spark, sf)
    protos = hd_language.prototypes(docs.filter(_remainder(3) != 1))
    got = hd_language.predict(docs, protos)
    return got.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op8_sanitise_pii(spark, sf):
    """Personal data of every document: counts by kind, a digest of the base spans and all spans."""
    got = sanitise.find_spans(documents(spark, sf))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return got.select("doc_id", *[n(k).alias(f"n_{k}") for k in sanitise.KINDS],
                      F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


@query
def op7_jaccard_prefix_join(spark, sf):
    """Every document's shingle count and the smallest doc_id it is linked with, over all documents."""
    return jaccard_join.jaccard_components(documents(spark, sf))


@query
def op9_prefix_free_repeats(spark, sf):
    """Bytes of every document that repeated 200-byte strings cover, and the hash of what is left."""
    got = pfp_dedup.remove_repeats(documents(spark, sf))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_merkle_postorder_log(spark, sf):
    """Every document's leaf, proof and root in the Merkle manifest, and the root folded from a tampered leaf."""
    return merkle_log.Manifest(documents(spark, sf), merkle_log.lower_cased(3)).proofs().drop("log_position")


@query
def op13_hard_negatives_angular(spark, sf):
    """Hard negatives of every 50th vector, after the labels of every 7th were moved on by one."""
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


@query
def op12_near_duplicates_binary_codes(spark, sf):
    """Every vector's links to vectors of its label at a cosine of 0.93 or more, and the smallest id it is linked with."""
    return binary_codes.near_duplicates(table(spark, sf, "embeddings"), 0.93)
