"""The corpus pipeline: documents in, token files out.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir), works
on everything its predecessor kept and returns a DataFrame, which ``run``
writes as Parquet and reads again for the next stage.  All stages but the last
return the columns of ``documents``:

* toxicity: documents scoring 0.5 or more go (CRF trained on labelled rows
  outside the held-out fifth);
* near duplicates: of every component of 5-word-shingle links (Jaccard 0.8 or
  more, exact join) the document with the smallest id stays;
* decontamination: documents in which a benchmark window of 10 words occurs go;
* mixing: every document as often as its source's target asks for (not at all,
  or up to three times);
* tokens: ids written to token files and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.llm import crf_toxicity, fm_index, jaccard_join, mixing, token_files
from reelrank.llm.store import documents, table
from reelrank.session import scratch_path

SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tagger = crf_toxicity.train(docs, table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return crf_toxicity.keep_clean(docs, tagger)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, PERCENT, SHINGLE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_index.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "pipeline-tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix", mix), ("tokens", tokens)]

#: The CRF and the tokenizer have no SQL form; test_pipeline_stages in tests/llm/test_placement.py compares near duplicates and
#: decontamination with brute force, of mixing and tokens only the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
