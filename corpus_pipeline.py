"""The corpus pipeline: stages over documents, each one's result written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontam, exact, langid, minhash
from textloom.llm.common import scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the language model on a bounded sample of labelled rows; documents that it rejects go."""
    return langid.not_rejected(docs, langid.train(docs, F.lit(True)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the one with the largest doc_id stays."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays."""
    return minhash.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in 20 inside a benchmark passage of 13 words go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of what is left: doc_id, n_tokens and digests of the ids and of the text they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("benchmark", decontaminate),
    ("tokens", tokenize),
]

#: SQL can't express the stages of the fitted language model, of min-max hashing and of byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, whole."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        where = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
