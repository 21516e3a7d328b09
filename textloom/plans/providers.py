"""What stands behind embedding, reranking, generating and keyword extraction.

Models that need a network are pluggable: a provider maps columns or tables of questions and texts, so one that calls
a model runs it in batches inside tasks. The ones here are deterministic and need no network.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap_share, tokens, truncated

class Embedder(Protocol):
    def embed(self, rows: DataFrame, id: str) -> DataFrame:
        """id, embedding of rows with id and text."""


class Reranker(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class Generator(Protocol):
    def answer(self, query: Column, context: Column) -> Column: ...


class HashingEmbedder:
    """Counts of tokens in buckets by their MD5, at unit length. Texts without tokens have no embedding."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, rows: DataFrame, id: str) -> DataFrame:
        token = rows.select(id, F.explode(tokens(F.col("text"))).alias("token"))
        digits = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long")
        counts = token.groupBy(id, F.pmod(digits, F.lit(self.dimensions)).cast("int").alias("at")).agg(F.count("*").alias("n"))
        return counts.groupBy(id).agg(F.collect_list(F.struct("at", "n")).alias("by")).select(id, filled(F.col("by"), self.dimensions).alias("embedding"))


def filled(counts: Column, n: int) -> Column:
    """The vector of n numbers, at unit length, of an array of (at, n) structs."""

    @F.arrow_udf("array<double>")
    def vectors(counts: pa.Array) -> pa.Array:
        each = counts.flatten()
        number = lambda k: each.field(k).to_numpy().astype(np.int64)
        out = np.zeros((len(counts), n), np.int64)
        out[pc.list_parent_indices(counts).to_numpy(), number(0)] = number(1)
        size = np.sqrt((out * out).sum(1).astype(np.float64))
        flat = pa.array((out / size[:, None]).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * n), flat)

    return vectors(counts)


class OverlapReranker:
    def score(self, query: Column, text: Column) -> Column:
        return overlap_share(tokens(query), tokens(text))


class ExtractiveGenerator:
    """Answers with the beginning of the context."""

    def __init__(self, most: int = 400):
        self.most = most

    def answer(self, query: Column, context: Column) -> Column:
        return truncated(context, self.most)


def rarest_words(queries: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    """query_id, keywords: each query's rarest words in the documents; stands in for a keyword model."""
    df = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).groupBy("word").count()
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    rare = words.where(F.length("word") > 3).join(df, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("count", "word")
    rare = rare.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    return rare.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "word"))), lambda s: s["word"]).alias("keywords"))
