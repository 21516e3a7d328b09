"""Fusing, reranking and selecting ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import overlap_share, tokens
from .lexical import ranked


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, Column | float]], constant: int = fixed.RRF_CONSTANT) -> DataFrame:
    """query_id, doc_id, score: the weighted sum of 1 / (constant + rank) over lists of (query_id, doc_id, rank)."""
    parts = [d.select("query_id", "doc_id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for d, w in lists]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def hybrid_weights(alpha: float) -> tuple[float, float]:
    """Weights of the lexical and the dense list, to two decimals."""
    return round(1 - alpha, 2), round(alpha, 2)


def score_fusion(dense: DataFrame, lexical: DataFrame, alpha: Column) -> DataFrame:
    """query_id, doc_id, score: alpha * min-max dense + (1 - alpha) * lexical by its maximum, over the union."""
    query = Window.partitionBy("query_id")
    both = dense.select("query_id", "doc_id", F.col("score").alias("dense")).join(
        lexical.select("query_id", "doc_id", F.col("score").alias("lexical")), ["query_id", "doc_id"], "full"
    )
    both = both.fillna(0.0, ["dense", "lexical"])
    low, high = F.min("dense").over(query), F.max("dense").over(query)
    most = F.max("lexical").over(query)
    scaled = both.select(
        "query_id",
        "doc_id",
        ((F.col("dense") - low) / (high - low + 1e-8)).alias("dense"),
        (F.col("lexical") / F.when(most == 0, 1.0).otherwise(most)).alias("lexical"),
    )
    return scaled.withColumn("score", alpha * F.col("dense") + (1 - alpha) * F.col("lexical"))


def overlap_rerank(results: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The results ordered anew by the share of the query's distinct words that the document has."""
    joined = results.select("query_id", "doc_id").join(
        queries.select("query_id", tokens(F.col("text")).alias("asked")), "query_id"
    )
    joined = joined.join(docs.select("doc_id", tokens(F.col("text")).alias("has")), "doc_id")
    scored = joined.select("query_id", "doc_id", overlap_share(F.col("asked"), F.col("has")).alias("rerank_score"))
    return ranked(scored, k, "rerank_score")


def first_by_prefix(results: DataFrame, text: str, order: list[Column], chars: int = fixed.PREFIX_CHARS) -> DataFrame:
    """Of a query's results whose texts begin alike, the first in the given order."""
    same = Window.partitionBy("query_id", F.left(F.col(text), F.lit(chars))).orderBy(*order)
    return results.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")


def sources_near_best(results: DataFrame, cutoff: float = fixed.SOURCE_CUTOFF) -> DataFrame:
    """query_id, source, score: each source's best score, where it reaches the cutoff share of the query's best."""
    best = results.groupBy("query_id", F.coalesce("source", F.lit("documento")).alias("source")).agg(F.max("score").alias("score"))
    top = F.max("score").over(Window.partitionBy("query_id"))
    return best.withColumn("_top", top).where(F.col("score") >= cutoff * F.col("_top")).drop("_top")
