"""From documents to token digests: toxicity, line dedup, near duplicates, decontamination, byte-level BPE.

Rows without a doc_id pass the filtering stages, which decide by doc_id. Rows that repeat a doc_id share its fate.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from gleanery.llm.shared import BROADCAST_IDS, checked_broadcast, saved


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    # texts stay where they are while the ids are few enough to be sent around
    ids = checked_broadcast(saved(rejected.select("doc_id").distinct(), "rejected"), BROADCAST_IDS)
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold of their language."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxicity.score_toxicity(docs, model).filter("rejected"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near duplicates (five words, similarity of 0.8)."""
    return _without(docs, ngram_join.ngram_classes(docs, width=5, percent=80).filter("component_id <> doc_id"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return _without(docs, decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: The classifier and the tokenizer cannot be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir; what each stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
