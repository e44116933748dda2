"""A training corpus from raw documents, stage by stage.

Language ID (documents in no learned language go), MinHash near-dedup (one
document of each group stays), substring dedup (repeated sentences go),
benchmark decontamination (documents that hold an item go), byte-level BPE
encoding and decoding. Each stage is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsignal.llm import bpe, decontam, langid, minhash, sentences
from shelfsignal.llm.common import scratch, shared_dir
from shelfsignal.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; rows as they were."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), the one of the smallest id."""
    return minhash.keep_one(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated spans; n_chars follows the text."""
    out = sentences.remove_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    path = tokenizer()
    coded = bpe.encode(docs.select("doc_id", "text"), path).select("doc_id", "ids", F.col("ids").alias("kept_ids"))
    out = bpe.decode_text(coded, path)
    return out.select("doc_id", F.size("kept_ids").cast("long").alias("n_tokens"), F.col("kept_ids").alias("ids"), "text")


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("bpe", tokenize)]

#: Language ID learns a model and near-dedup needs components: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        with scratch(spark):  # what a stage's operator wrote on its way goes once the stage is written
            path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
            found = function(spark, docs, sf_dir)
            found.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
